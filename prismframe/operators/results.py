"""Relational steps over tables of measurements (REL01-REL12, SNK01-SNK03)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_rhs") -> DataFrame:
    """REL01: on all key columns; other columns of the right side that the left one has get a suffix."""
    clash = set(left.columns) & set(right.columns) - set(keys)
    return left.join(right.select(*(F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns)), list(keys), "left")


#: What a method's measurements are joined with its timings on.
METHOD_KEYS = {
    "tree": ("n", "d", "m", "codebooks", "work"), "vq4": ("n", "d", "m", "codebooks"), "hash_sketch": ("n", "d", "m", "sketch", "s"),
    "dense_sketch": ("n", "d", "m", "sketch"), "exact": ("n", "d", "m"), "scalar_quantize": ("n", "d", "m"),
}


def join_timings(quality: DataFrame, timings: DataFrame, families: Mapping[str, Sequence[str]] = METHOD_KEYS, family: str = "family") -> DataFrame:
    """REL02, REL08: every family on its own keys, then one table with all columns."""
    out = None
    for name, keys in families.items():
        part = left_join(quality.filter(F.col(family) == name), timings.filter(F.col(family) == name).drop(family), keys)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def at_or_below(left: DataFrame, right: DataFrame, keys: Sequence[str], target: str, value: str, id_col: str, other_id: str | None = None) -> DataFrame:
    """REL03: each left row with the right row of its keys whose value is the largest at or below the target, else the smallest.

    With ``other_id``, ties go to its smallest value, and a right row whose id is the left row's own is left out.
    """
    other = F.col(other_id) if other_id else F.lit(0)
    found = F.struct(value, other.alias("__o"), *(c for c in right.columns if c not in keys and c != value)).alias("__f")
    marks = left.select(*keys, F.col(target).alias("__v"), F.struct(*left.columns).alias("__l"))
    both = right.select(*keys, F.col(value).alias("__v"), found).unionByName(marks, allowMissingColumns=True)
    # right rows from the smallest value, of equal ones the smallest id last; a left row comes after those that its target reaches
    low = Window.partitionBy(*keys).orderBy("__v", F.col("__l").isNotNull(), F.col("__f.__o").desc())
    # and the other way round: from the largest value, the smallest id last again
    high = Window.partitionBy(*keys).orderBy(F.desc("__v"), F.col("__l").isNull(), F.col("__f.__o").desc())

    def last_two(w: WindowSpec, name: str) -> dict[str, Column]:
        """The last right row up to here and the one before it."""
        seen = w.rowsBetween(Window.unboundedPreceding, 0)
        return {f"{name}1": F.last("__f", ignorenulls=True).over(seen), f"{name}2": F.last("__g", ignorenulls=True).over(seen)}

    for w, name in ((low, "__low"), (high, "__high")):
        # for a right row the one before it among right rows: left rows between them have none
        both = both.withColumn("__g", F.when(F.col("__f").isNotNull(), F.struct(F.last("__f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("f"))))
        both = both.withColumns(last_two(w, name))
    own = F.col(f"__l.{id_col}")

    def first_of(*names: str) -> Column:
        rows = [F.col(n) if n.endswith("1") else F.col(f"{n}.f") for n in names]
        ok = (lambda r: r.isNotNull() & (r["__o"] != own)) if other_id else (lambda r: r.isNotNull())
        return F.coalesce(*(F.when(ok(r), r) for r in rows))

    best = both.filter("__l IS NOT NULL").withColumn("__b", first_of("__low1", "__low2", "__high1", "__high2")).filter("__b IS NOT NULL")
    return best.select("__l.*", *(F.col(f"__b.{c}") for c in right.columns if c not in keys))


def pareto(df: DataFrame, x: str, y: str, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """REL04: rows, x ascending, whose y is above that of all rows before; of equal x the largest y comes first."""
    w = Window.partitionBy(*by).orderBy(x, F.desc(y), id_col).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__m", F.max(y).over(w)).filter(F.col("__m").isNull() | (F.col(y) > F.col("__m"))).drop("__m")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "timing_trial", value: str = "time") -> DataFrame:
    """REL05."""
    return df.unpivot(list(ids), list(values), name, value)


def share_above(df: DataFrame, by: Sequence[str], y: str, threshold: float) -> DataFrame:
    """REL06."""
    return df.groupBy(*by).agg(F.avg((F.col(y) > threshold).cast("int")).alias("share"))


def remap(df: DataFrame, c: str, names: Mapping[str, str]) -> DataFrame:
    """REL07: values renamed; rows of other values go."""
    pairs = [F.lit(x) for p in names.items() for x in p]
    return df.withColumn(c, F.try_element_at(F.create_map(*pairs), F.col(c))).filter(F.col(c).isNotNull())


def union_outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """REL08."""
    return a.unionByName(b, allowMissingColumns=True)


def speedups(df: DataFrame, by: Sequence[str], method: str, baseline: str, time: str, trials: Sequence[str] = ()) -> DataFrame:
    """REL09: a missing time is the mean of its trials; ``throughput``, and ``speedup`` against the baseline's mean time in the same group."""
    there = [F.col(t) for t in trials]
    if there:
        some = F.filter(F.array(*there), lambda t: t.isNotNull())
        df = df.withColumn(time, F.coalesce(F.col(time), F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, t: s + t), F.size(some))))
    base = F.avg(F.when(F.col(method) == baseline, F.col(time))).over(Window.partitionBy(*by))
    return df.withColumns({"throughput": F.try_divide(F.lit(1.0), F.col(time)), "speedup": F.try_divide(base, F.col(time))})


def text_filters(df: DataFrame, c: str, prefix: str = "", suffix: str = "", drop: Sequence[str] = ()) -> DataFrame:
    """REL10, FLT02: values trimmed and lower-cased, kept by prefix and suffix; columns dropped."""
    return df.withColumn(c, F.lower(F.trim(c))).filter(F.col(c).startswith(prefix) & F.col(c).endswith(suffix)).drop(*drop)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """REL11, SNK01: of rows with equal keys the last; columns in alphabetical order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) if isinstance(o, str) else o for o in order))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").select(*sorted(df.columns))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """REL12."""
    return df.groupBy(c).agg(F.count("*").alias("n"))


def is_unique(df: DataFrame, c: str) -> DataFrame:
    """REL12: one row: rows, distinct values, and whether they are as many."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(c).alias("n_distinct"), (F.count("*") == F.count_distinct(c)).alias("all_distinct"))
