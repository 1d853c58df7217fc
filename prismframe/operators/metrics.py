"""How near an approximation comes, and how small it is (MET01-MET08, FLT01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismframe.functions import vector as V


def recall_at(approx: DataFrame, exact: DataFrame, at: list[int]) -> DataFrame:
    """MET02: (r, recall): how many queries have their nearest row among the first r approximate ones. Both have query_id, id, rank."""
    truth = exact.filter("rank = 1").select("query_id", "id")
    found = truth.join(approx.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    cells = F.array(*(F.struct(F.lit(r).alias("r"), F.coalesce((F.col("rank") <= r).cast("int"), F.lit(0)).alias("hit")) for r in at))
    return found.select(F.explode(cells).alias("c")).groupBy(F.col("c.r").alias("r")).agg(F.avg("c.hit").alias("recall"))


def precision_at(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """MET03: (query_id, precision): the shared part of the two sets of k."""
    lists = [x.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list("id").alias(n)) for x, n in ((approx, "a"), (exact, "b"))]
    return lists[1].join(lists[0], "query_id", "left").select("query_id", (F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)) / k).alias("precision"))


def share_below_farthest(scanned: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """MET04: one row (mean, std, p50, p90) of the share of rows that are scanned no farther than the farthest of the true k."""
    true = exact.filter(F.col("rank") <= k).select("query_id", "id")
    top = scanned.join(true, ["query_id", "id"]).groupBy("query_id").agg(F.max("dist").alias("top"))
    share = scanned.join(top, "query_id").groupBy("query_id").agg(F.avg((F.col("dist") <= F.col("top")).cast("int")).alias("share"))
    return share.agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"), F.percentile("share", F.lit(0.5)).alias("p50"), F.percentile("share", F.lit(0.9)).alias("p90"))


def error_stats(pairs: DataFrame, true: str, approx: str) -> DataFrame:
    """MET05, DST10: relative errors (without those that aren't finite) and the correlation."""
    rel = F.try_divide(F.col(approx) - F.col(true), F.col(true))
    rows = pairs.withColumn("rel", F.when(F.abs(rel) < float("inf"), rel))
    return rows.agg(
        F.corr(true, approx).alias("corr"), F.avg("rel").alias("rel_mean"), F.stddev_pop("rel").alias("rel_std"), F.avg(F.col("rel") * F.col("rel")).alias("rel2_mean"),
        F.avg(F.pow(F.col(true) - F.col(approx), F.lit(2.0))).alias("mse"), F.count("rel").alias("n"),
    )


def accuracy(rows: DataFrame, pred: str, label: str) -> DataFrame:
    """MET06."""
    return rows.agg(F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def gradient_nmse(rows: DataFrame, true: str, approx: str) -> DataFrame:
    """MET07: of gradient magnitudes, from ARRAY columns with both derivatives."""
    size = lambda c: F.sqrt(F.col(c)[0] * F.col(c)[0] + F.col(c)[1] * F.col(c)[1])
    g = rows.select(size(true).alias("g"), size(approx).alias("h"))
    return g.agg((F.avg(F.pow(F.col("g") - F.col("h"), F.lit(2.0))) / F.var_pop("g")).alias("nmse"))


def packed_size(df: DataFrame, order: Column, columns: list[str], wide: bool = True, series: list[str] | None = None) -> DataFrame:
    """MET08: (series, bytes): integers packed by blocks of 8 rows.

    Bits are those of unsigned values; a series with any negative value is zigzag-coded first, all its columns. A block's column takes the bits of its widest value (15 counts as 16, 7 as 8 in 8-bit data), times 8 rows, so as many bytes as bits. A
    block has a header of 4 bits a column (3 in 8-bit data); a run of blocks of nothing but zeros costs one byte in all.
    """
    series = series or []
    top, header = (15, 4) if wide else (7, 3)
    order_by = Window.partitionBy(*series).orderBy(order) if series else Window.orderBy(order)
    rows = df.withColumn("block", F.floor((F.row_number().over(order_by) - 1) / 8))
    # a window like that of the numbering, so that the series are dealt out once
    least = F.min(F.least(*columns) if len(columns) > 1 else F.col(columns[0])).over(Window.partitionBy(*series))
    rows = rows.withColumn("__signed", least < 0)
    widest = [F.max(V.nbits_unsigned(F.when(F.col("__signed"), V.zigzag(F.col(c))).otherwise(F.col(c)))).alias(c) for c in columns]
    blocks = rows.groupBy(*series, "block").agg(*widest)
    bits = sum((F.when(F.col(c) == top, top + 1).otherwise(F.col(c)) for c in columns[1:]), F.when(F.col(columns[0]) == top, top + 1).otherwise(F.col(columns[0])))
    w = (Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))).orderBy("block")
    blocks = blocks.select(*series, "block", bits.alias("bits")).withColumn("before", F.lag("bits").over(w))
    head = F.lit(-(-header * len(columns) // 8))
    cost = F.when(F.col("bits") > 0, F.col("bits") + head).when(F.col("before") == 0, F.lit(0)).otherwise(F.lit(1))
    return blocks.groupBy(*series).agg(F.sum(cost).cast("long").alias("bytes"))
