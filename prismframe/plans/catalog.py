"""Registry of the engine's queries and their SQL oracles."""

from prismframe.plans import files, measurements, parts, products, search, series  # noqa: F401
from prismframe.plans.base import ORACLES, QUERIES  # noqa: F401
