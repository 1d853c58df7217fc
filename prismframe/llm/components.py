"""Connected components by label propagation with pointer jumping; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismframe.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b): the smallest vertex that it is joined with. Neither side may be null.

    A round takes the least label among neighbours (partial minima before the shuffle) and then the label of that label, so rounds
    grow with the logarithm of a component's width. Nothing is collected but the number of labels that changed.
    """
    edges = common.written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        after = common.written(lower.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = after.filter("label <> old").count()
        labels = after.select("v", "label")
        if not moved:
            return labels
