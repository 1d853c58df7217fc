"""Temperature mixing: sources weighted by their token shares to a power, the power bisected, the weights realised block by block.

The share q of a source becomes q ** a, normalised. At a = 1 the mix is the corpus; the smaller a, the more even the sources and
the more often small ones repeat. ``weights`` bisects a in steps of 1e-6: the largest a in [0, 1] whose entropy, as a part of that
of even sources, reaches ``entropy``, but none at which a source would be read more than ``repeats`` times over the budget.

``mix`` realises the weights. A source's quota is its weight times the budget. Its documents are read epoch after epoch, each
epoch in a permutation of its own (the order of a hash of seed, epoch and id); the last, partial one ends before the quota would
be passed. Place in that stream over quota is the block, so every block holds each source in its weight, and a block is ordered by
another hash. Running sums over a source of any size take two steps: hash ranges are summed, the sums of ranges are added up
(a row a range), and only the rows of one range are ordered together.

Defined results: tokens are whitespace-separated words; documents without any are left out; a null source is the source "";
rows equal in id and text are one document, counted and read once (of several sources the first by name counts); texts of any length count whole,
and one longer than its source's quota is left out; places are drawn by id, for null ids by the text; an empty table gives no rows; extra
columns pass through, and those named like an output are kept as ``input_<name>``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismframe.llm import common

STEPS = 1_000_000


@dataclass(frozen=True)
class Settings:
    entropy: float = 0.95  #: target, as a part of the entropy of even sources
    repeats: float = 4.0  #: a source is read at most so often over the budget
    budget: int | None = None  #: tokens of the mix; None: as many as the corpus has
    block_tokens: int = 250_000
    seed: int = 7
    range_rows: int = 4096  #: rows of a hash range, about
    most_sources: int = 1_000_000  #: the sources' sums are held by the driver


def powered(shares: list[float], a: float) -> list[float]:
    raised = [q**a for q in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def evenness(p: list[float]) -> float:
    return 1.0 if len(p) < 2 else -math.fsum(x * math.log(x) for x in p if x > 0) / math.log(len(p))


def weights(tokens: dict[str, int], s: Settings) -> tuple[float, dict[str, float], int]:
    """The exponent, the weight of each source and the budget. Sources without tokens have no weight."""
    names = sorted(k for k, v in tokens.items() if v > 0)
    total = sum(tokens[k] for k in names)
    budget = total if s.budget is None else s.budget
    if not names:
        return 1.0, {}, 0
    if budget > s.repeats * total:
        raise ValueError(f"a budget of {budget} tokens reads {total} tokens more than {s.repeats} times")
    shares = [tokens[k] / total for k in names]

    def largest(ok) -> int:
        """The largest step at which ``ok`` holds, which holds below it too; 0 if at none."""
        low, high = 0, STEPS + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if ok(powered(shares, mid / STEPS)) else (low, mid)
        return low

    even = largest(lambda p: round(evenness(p), 12) >= s.entropy)
    # how often the most repeated source is read falls as the exponent grows
    fails = largest(lambda p: max(x * budget / tokens[k] for x, k in zip(p, names, strict=True)) > s.repeats + 1e-9)
    least = fails + 1 if max(x * budget / tokens[k] for x, k in zip(powered(shares, 0.0), names, strict=True)) > s.repeats + 1e-9 else 0
    a = min(STEPS, max(even, least)) / STEPS
    return a, {k: round(x, 12) for k, x in zip(names, powered(shares, a), strict=True)}, budget


def _hash(seed: int, what: Column) -> Column:
    own = F.coalesce(F.col("d").cast("string"), F.concat(F.lit("null "), F.col("t").cast("string")))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), what.cast("string"), own).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", s: Settings = Settings()) -> DataFrame:
    """(d, t, source, tokens, epoch, block, slot, copies): one row for each time a document is read; d and t are its id and text hash, copies its rows."""
    spark = docs.sparkSession
    slim = common.written(
        docs.select(
            F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
            common.word_count(F.col(f"`{text}`")).alias("tokens"),
        ).filter("tokens > 0").groupBy("d", "t").agg(F.min("source").alias("source"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    )
    sums = slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(s.most_sources + 1).collect()
    if len(sums) > s.most_sources:
        raise ValueError(f"more than {s.most_sources} sources")
    tokens = {r["source"]: r["tokens"] for r in sums}
    _, p, budget = weights(tokens, s)
    blocks = max(1, -(-budget // s.block_tokens))
    quotas = [(k, tokens[k], int(math.floor(p[k] * budget))) for k in sorted(p)]
    quota = spark.createDataFrame(quotas, "source string, whole long, quota long").withColumns(
        {"epochs": F.expr("cast(ceil(quota / whole) as int)")}
    )
    quota = F.broadcast(quota) if len(quotas) <= 10_000 else quota
    rows = sum(r["n"] for r in sums)
    bits = max(0, math.ceil(math.log2(max(1, rows / s.range_rows))))
    copies = (
        slim.join(quota, "source")
        .filter("epochs > 0")
        .select("d", "t", "source", "tokens", "copies", "whole", "quota", F.explode(F.sequence(F.lit(1), "epochs")).alias("epoch"))
        .withColumn("key", _hash(s.seed, F.col("epoch")))
        .withColumn("part", F.shiftright("key", 60 - bits) if bits else F.lit(0).cast("long"))
    )
    ranges = copies.groupBy("source", "epoch", "part").agg(F.sum("tokens").alias("sum"))
    over = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "epoch", "part", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "epoch", "part").orderBy("key", "d", "t").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.withColumn("upto", F.sum("tokens").over(within)).join(ranges, ["source", "epoch", "part"])
    place = (F.col("epoch") - 1) * F.col("whole") + F.col("ahead") + F.col("upto")
    block = F.least(F.lit(blocks - 1), F.floor((F.col("end") - F.col("tokens")).cast("double") / F.col("quota") * blocks))
    return (
        placed.withColumn("end", place)
        .filter("end <= quota")
        .select("d", "t", "source", "tokens", "copies", "epoch", block.cast("long").alias("block"), _hash(s.seed, F.concat(F.lit("slot"), F.col("epoch").cast("string"))).alias("slot"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", s: Settings = Settings()) -> DataFrame:
    """All columns, one row for each time a document is read, with ``epoch``, ``block`` and ``slot``; inputs of these names become ``input_<name>``."""
    outputs = ("epoch", "block", "slot")
    read = common.written(mix(docs, id_col, text, source, s).select(F.col("d").alias("__d"), F.col("t").alias("__t"), "copies", *outputs))
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    named = docs.select(given, F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__h"))
    rows = named.join(read, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")))
    if read.filter("copies > 1").limit(1).count():  # rows that repeat are read once; without any, the texts needn't be dealt out again
        rows = rows.withColumn("__k", F.xxhash64("__d", "__t")).dropDuplicates(["__k", "__t", "epoch"])
    columns = (F.col("__row")[c].alias(f"input_{c}" if c in outputs else c) for c in docs.columns)
    return rows.select(*columns, *outputs)
