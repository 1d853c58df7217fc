"""Samples, splits, folds and grids that come out the same on any cluster (SMP01-SMP04, GRD01, TRN13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(id_col: str, seed: int = 0) -> Column:
    """An arithmetic permutation of ids, the same in every engine: (a * id + b) modulo a prime."""
    return F.pmod(F.col(id_col).cast("long") * 48271 + 11 + seed, F.lit(2147483647))


def quotas(counts: Mapping, k: int) -> dict:
    """SMP01: classes from the rarest on get their share of what is left, at least one, at most all they have."""
    left_k, left_n, out = k, sum(counts.values()), {}
    for label, n in sorted(counts.items(), key=lambda p: (p[1], p[0])):
        take = min(n, max(1, int(left_k * n / left_n + 0.999))) if left_n and left_k > 0 else 0
        out[label] = take
        left_k, left_n = left_k - take, left_n - n
    return out


def balanced(df: DataFrame, label: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """SMP01: k rows, balanced by class; labels are few (their counts are collected)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    want = F.lit(0)
    for y, n in quotas(counts, k).items():
        want = F.when(F.col(label).eqNullSafe(F.lit(y)), F.lit(n)).otherwise(want)
    return first_per_class(df, label, id_col, want, seed)


def first_per_class(df: DataFrame, label: str, id_col: str, n: int | Column, seed: int = 0) -> DataFrame:
    """SMP04: at most n rows of each class."""
    order = Window.partitionBy(label).orderBy(shuffle_key(id_col, seed), id_col)
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")


def stratified_split(df: DataFrame, label: str, id_col: str, test: float, seed: int = 0) -> DataFrame:
    """SMP02: adds ``is_test``: of each class, the first share by the shuffle."""
    order = Window.partitionBy(label).orderBy(shuffle_key(id_col, seed), id_col)
    rank, n = F.row_number().over(order), F.count("*").over(Window.partitionBy(label))
    return df.withColumn("is_test", rank <= F.floor(n * test + 0.5))


def k_folds(df: DataFrame, label: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """SMP03: adds ``fold``, 0 to k - 1, dealt out round by round inside each class."""
    order = Window.partitionBy(label).orderBy(shuffle_key(id_col, seed), id_col)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def block_sample(df: DataFrame, id_col: str, start: int, n: int) -> DataFrame:
    """TRN13: n rows in a stretch of the id order."""
    return df.orderBy(id_col).offset(start).limit(n)


def grid(options: Mapping[str, Sequence], conditional: Mapping[str, Mapping] | None = None) -> list[dict]:
    """GRD01: all combinations; ``conditional`` names a key that counts only if others have given values."""
    out, conditional = [], conditional or {}
    for values in product(*options.values()):
        row = dict(zip(options, values, strict=True))
        row = {k: v for k, v in row.items() if all(row.get(a) == b for a, b in conditional.get(k, {}).items())}
        if row not in out:
            out.append(row)
    return out
