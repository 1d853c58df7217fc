"""Tables of results that grow by appending (SNK01-SNK04)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.operators.results import keep_last


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_appended(df: DataFrame, path: str, dedup: Sequence[str], sort_by: Sequence[str] = (), timestamp: bool = False) -> DataFrame:
    """SNK01, SNK02: what is there and the new rows; of rows with equal keys the newest stays; columns in alphabetical order.

    The new table is written beside the old one, which is replaced only after that.
    """
    spark = df.sparkSession
    df = df.withColumn("saved_at", F.current_timestamp()) if timestamp else df
    old = spark.read.parquet(path) if exists(spark, path) else None
    both = df.withColumn("__seq", F.lit(1)) if old is None else old.withColumn("__seq", F.lit(0)).unionByName(df.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    columns = sorted(set(both.columns) - {"__seq"})
    last = keep_last(both, dedup, ["__seq"]).select(*columns)
    last = last.orderBy(*sort_by) if sort_by else last
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    last.write.parquet(beside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(beside), hadoop(path))
    return spark.read.parquet(path)


def save_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """SNK03: a folder for each combination of parameters; rows of one go to few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def memoized(spark: SparkSession, path: str, make) -> DataFrame:
    """SNK04: the table at ``path``, made first if it isn't there."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)
