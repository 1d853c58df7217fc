"""Quantised lookup tables: a percentile grid (TRN12) and joint power-of-two scales (MIT17)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of a codebook's entries that may fall below its floor and above the common ceiling.
ALPHAS = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)


def grid(luts: np.ndarray, alphas: tuple[float, ...] = ALPHAS, compat: bool = False) -> tuple[np.ndarray, float, float]:
    """(floors of the codebooks, scale, alpha) of least squared loss over (queries, codebooks, entries).

    The loss is between the table and what the quantised one stands for; ``compat`` measures only what the floor cuts off, and takes the
    last of equal losses. On ties the smaller alpha is taken otherwise.
    """
    best = None
    for a in alphas:
        floors = np.percentile(luts, 100 * a, axis=(0, 2))
        over = np.maximum(0, luts - floors[None, :, None])
        top = np.percentile(over, 100 - 100 * a)
        scale = 255.0 / top if top > 0 else 1.0
        q = np.minimum(255, np.floor(over * scale))
        ideal = luts - (over if compat else floors[None, :, None])
        loss = float(((ideal - q / scale) ** 2).sum())
        if best is None or loss < best[0] or (compat and loss == best[0]):
            best = (loss, floors, scale, a)
    return best[1], best[2], best[3]


def quantize(luts: np.ndarray, floors: np.ndarray, scale: float) -> np.ndarray:
    return np.minimum(255, np.floor(np.maximum(0, luts - floors[:, None]) * scale)).astype(np.int64)


def power_of_two(luts: np.ndarray) -> tuple[np.ndarray, float]:
    """(offsets, scale): each codebook's least entry, and one scale from the widest codebook."""
    low, high = luts.min(axis=(0, 2)), luts.max(axis=(0, 2))
    gap = float((high - low).max())
    scale = 2.0 ** -math.ceil(math.log2(gap)) * (255.5 - 1e-10) if gap > 0 else 1.0
    return low, scale


def quantize_half(luts: np.ndarray, offsets: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.trunc((luts - offsets[:, None]) * scale + 0.5), 0, 255).astype(np.int64)


def grid_table(entries: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """TRN12 in SQL: (alpha, scale, loss) from rows (codebook, x), one for every entry of every query's table."""
    spread = entries.select("codebook", "x", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))

    def at(p: float, c: str) -> Column:
        return F.percentile(c, F.lit(p))

    floors = entries.groupBy("codebook").agg(F.array(*(F.struct(F.lit(a).alias("alpha"), at(a, "x").alias("floor")) for a in alphas)).alias("f"))
    floors = floors.select("codebook", F.explode("f").alias("f")).select("codebook", F.col("f.alpha").alias("alpha"), F.col("f.floor").alias("floor"))
    over = spread.join(F.broadcast(floors), ["codebook", "alpha"]).withColumn("over", F.greatest(F.lit(0.0), F.col("x") - F.col("floor")))
    tops = over.groupBy("alpha").agg(F.array(*(at(1 - a, "over") for a in alphas)).alias("tops"))
    places = F.array(*map(F.lit, alphas))
    tops = tops.select("alpha", F.col("tops")[(F.array_position(places, F.col("alpha")) - 1).cast("int")].alias("top"))
    scaled = over.join(F.broadcast(tops), "alpha").withColumn("scale", F.when(F.col("top") > 0, F.lit(255.0) / F.col("top")).otherwise(1.0))
    q = F.least(F.lit(255.0), F.floor(F.col("over") * F.col("scale")).cast("double"))
    loss = F.pow(F.col("x") - F.col("floor") - q / F.col("scale"), F.lit(2.0))
    return scaled.groupBy("alpha", "scale").agg(F.sum(loss).alias("loss"))
