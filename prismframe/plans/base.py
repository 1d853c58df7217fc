"""What the query modules share: tables, the registry, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def asked(df: DataFrame) -> DataFrame:
    """The query rows of a search: those whose id is divisible by 50. All rows are searched."""
    return df.filter("vec_id % 50 = 0")


#: Fixed sizes of the given codebook: 16 subspaces of 4 components, 16 centroids.
CODEBOOKS, SPAN, CENTROIDS = 16, 4, 16


def books(df: DataFrame) -> list[np.ndarray]:
    """The given codebook: centroid k of every subspace is the rounded mean of the vectors whose id has remainder k modulo 16."""
    flat = df.select((F.col("vec_id") % CENTROIDS).alias("k"), F.posexplode("embedding").alias("pos", "x"))
    rows = flat.groupBy("k", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x")).collect()
    out = np.zeros((CENTROIDS, CODEBOOKS * SPAN))
    for r in rows:
        out[r["k"], r["pos"]] = r["x"]
    return [out[:, c * SPAN : (c + 1) * SPAN] for c in range(CODEBOOKS)]


FLAT = """flat AS (
  SELECT vec_id, label, i AS pos, embedding[i + 1]::DOUBLE AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)
)"""
CENT = FLAT + """, cent AS (
  SELECT pos // 4 AS c, pos, vec_id % 16 AS k, round(avg(x), 6) AS y FROM flat GROUP BY ALL
)"""
CODES = CENT + """, cell AS (
  SELECT vec_id, c, k, sum((x - y) * (x - y)) AS d2, sum(x * y) AS dot FROM flat JOIN cent USING (pos) GROUP BY vec_id, c, k
), codes AS (
  SELECT vec_id, c, arg_min(k, (d2, k)) AS code FROM cell GROUP BY vec_id, c
)"""


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: power({a}[i]::DOUBLE - {b}[i]::DOUBLE, 2)))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"


def ranked(dist: str, where: str = "TRUE", order: str = "d, id", k: int = 10) -> str:
    """The k nearest of each query by a distance between rows b and q."""
    return f"""
  SELECT query_id, id, round(d, 6) AS dist, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INT AS rank FROM (
      SELECT q.vec_id AS query_id, b.vec_id AS id, {dist} AS d FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0 AND {where}))
  WHERE rank <= {k}"""


def cells(df: DataFrame, id_col: str, vector: str, digits: int = 6) -> DataFrame:
    """(id, pos, x): the components of a vector column, rounded."""
    return df.select(id_col, F.posexplode(vector).alias("pos", "x")).select(id_col, "pos", F.round(F.col("x").cast("double"), digits).alias("x"))
