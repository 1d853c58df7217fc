"""Generated vectors (SRC04, SRC05). The same seed gives the same rows on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(i: Column, j: Column | int, seed: int, salt: int = 0) -> Column:
    """A number in (0, 1) that hangs on row, place and seed alone."""
    j = F.lit(j) if isinstance(j, int) else j
    return (F.pmod(F.xxhash64(i, j.cast("long"), F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(i: Column, j: Column | int, seed: int, salt: int = 0) -> Column:
    return F.sqrt(F.log(uniform(i, j, seed, 2 * salt + 1)) * -2) * F.cos(uniform(i, j, seed, 2 * salt + 2) * 6.283185307179586)


def vectors(spark: SparkSession, n: int, dim: int, kind: str = "gauss", seed: int = 0, centers: int = 32, spread: float = 8.0) -> DataFrame:
    """SRC04: (vec_id, embedding): uniform, gauss, walk (running sums of gauss) or blobs (``centers`` of them, ``spread`` apart)."""
    rows = spark.range(n).withColumnRenamed("id", "vec_id")
    i, places = F.col("vec_id"), F.sequence(F.lit(0), F.lit(dim - 1))
    if kind == "uniform":
        v = F.transform(places, lambda j: uniform(i, j, seed))
    elif kind == "blobs":
        c = F.pmod(F.xxhash64(i, F.lit(seed + 7)), F.lit(centers))
        v = F.transform(places, lambda j: normal(c, j, seed, 9) * spread + normal(i, j, seed))
    else:
        v = F.transform(places, lambda j: normal(i, j, seed))
    if kind == "walk":
        steps = v
        v = F.slice(F.aggregate(steps, F.array(F.lit(0.0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x)), 2, dim)
    return rows.select("vec_id", v.alias("embedding"))
