"""Every registered query of the engine runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from prismframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


def missing(x) -> bool:
    return x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    order = sorted(got.columns)
    a, b = (sorted(map(tuple, (tuple(None if missing(v) else v for v in r) for r in x[order].itertuples(index=False))), key=repr) for x in (got, want))
    plain = lambda r: tuple(float(v) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else v for v in r)
    a, b = (sorted((plain(r) for r in x), key=repr) for x in (a, b))
    assert a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n != "amm_methods"])
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        same(got, duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
