"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact weighted verification. Native.

Texts are lower-cased and cut into words (runs of letters and digits); a shingle is five words. A document leaks an item if one of
its windows, as many words long as the item, holds at least ``least`` of the item's shingles by weight; a shingle's weight is one over
the number of items that hold it, and nothing if no item does. Steps:

1. Windows. Only shingles of items weigh anything, and a window moved on to its first shingle of an item holds no less of that item. So every
   window counts that starts at a shingle of an item and has the size of an item that holds it; no other window has a higher similarity
   with any item. A window whose whole weight is below ``least`` of the lightest such item can't reach it and ends here.
2. SimHash: ``BITS`` bits of the window's shingles (those of items of its size), a shingle counting by the root of its weight, so that two
   fingerprints differ by the angle between the weighted sets. Items have fingerprints too.
3. Multi-index: fingerprints are cut into ``BLOCKS`` blocks. Two that differ in at most ``RADIUS`` bits differ in at most one bit in one block
   at least, so the index, which holds each item's blocks with up to one bit flipped, meets every pair of one size within the radius.
   Beyond the threshold a window without foreign shingles has a cosine of 0.894 or more, and of 0.8 with as much as makes up the missing
   weight: 51.6 bits differ then, 6.4 standard deviation, so at the worst one pair in 1000 is beyond the radius of 71.
   Where much weight of a window is of other items than the one that holds most of it, the angle says little: such a window (``PURE``) is compared
   with all items of its size that hold its first shingle, which is exact.
4. Pairs are verified by the exact similarity over their shingles.

Defined results: items and documents of fewer than five words have no shingle and leak nothing; a null text is empty; a document that ends
inside a window gives a shorter window; a very long text is cut into windows like any other; of equal windows the first is reported; items of one id
and different texts are all looked for; rows equal in id and text are one document; empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismframe.llm import common

WORDS = 5
LEAST = 0.8
#: A fingerprint is four longs of 63 bits, cut into blocks of 7 bits.
LONGS, BLOCK_BITS = 4, 7
BITS, BLOCKS = LONGS * 63, LONGS * 9
RADIUS = 2 * BLOCKS - 1
#: Sums of three bits lie beside one another in a long.
LANE = 21
#: A window's share of weight that one item must hold for the fingerprint to speak for it.
PURE = 0.8
#: Rows that a side of a join may have to be broadcast: some 50 MB of shingles.
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """The words of a text."""

    def trimmed(w: Column) -> Column:
        # a text that begins or ends between words has an empty one there
        first = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)
        last = F.when(F.element_at(w, -1) == "", 1).otherwise(0)
        return F.slice(w, first + 1, F.greatest(F.lit(0), F.size(w) - first - last))

    return common.let(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), trimmed)


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds ``n`` (the number of words) and ``hs`` (the hash of the shingle at each place)."""

    def both(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(w[i + k] for k in range(WORDS))))
        return F.struct(F.size(w).alias("n"), F.when(F.size(w) >= WORDS, hashes).otherwise(F.array().cast("array<bigint>")).alias("hs"))

    return df.withColumn("__made", common.let(words(F.col(text)), both)).withColumns({"n": F.col("__made.n"), "hs": F.col("__made.hs")}).drop("__made")


def _few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """For a join: broadcast if it has so few rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _sum(parts: Column, value) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + value(p))


def fingerprint(parts: str) -> Column:
    """The SimHash of a column of weighted shingles (h, w), as ``LONGS`` longs. A bit is set if the shingles that have it weigh more than half."""
    lanes = sum(1 << (LANE * j) for j in range(3))
    # weights are whole numbers, small enough for a lane to hold their sum; bit i of a hash is summed in lane i / LANE of sum i % LANE
    top = f"least(255, floor({1 << LANE} / greatest(size({parts}), 1)) - 1)"
    hashes = ", ".join(f"xxhash64(p.h, {k})" for k in range(LONGS))
    rows = f"transform({parts}, p -> struct(array({hashes}) AS x, bigint(ceil(sqrt(p.w) * {top})) AS q))"
    sums = f"transform(sequence(0, {LANE - 1}), b -> aggregate(rows, 0L, (s, r) -> s + (shiftrightunsigned(r.x[k], b) & {lanes}L) * r.q))"
    bit = f"(shiftrightunsigned(sums[i % {LANE}], {LANE} * int(i / {LANE})) & {(1 << LANE) - 1}L) * 2 > half"
    packed = f"transform(array({sums}), sums -> aggregate(sequence(0, 62), 0L, (o, i) -> o + if({bit}, shiftleft(1L, i), 0L)))[0]"
    halves = f"transform(array(aggregate(rows, 0L, (s, r) -> s + r.q)), half -> transform(sequence(0, {LONGS - 1}), k -> {packed}))[0]"
    return F.expr(f"transform(array({rows}), rows -> {halves})[0]")


def _block(f: str) -> str:
    return f"shiftrightunsigned({f}[int(i / 9)], {BLOCK_BITS} * (i % 9)) & {(1 << BLOCK_BITS) - 1}L"


def blocks(f: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), i -> struct(i AS block, {_block(f)} AS value))")


def within(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(w, i) of windows (w, n, f) and items (i, n, g) of one size whose fingerprints differ in at most ``RADIUS`` bits."""
    flips = F.array(*(F.lit(x) for x in (0, *(1 << b for b in range(BLOCK_BITS)))))
    index = items.select("i", "n", "g", F.explode(blocks("g")).alias("b"))
    index = index.select("i", "n", "g", "b.block", F.col("b.value").alias("exact"), F.explode(flips).alias("flip"))
    index = index.select("i", "n", "g", "block", F.col("exact").bitwiseXOR(F.col("flip")).alias("value"))
    probes = prints.select("w", "n", "f", F.explode(blocks("f")).alias("b")).select("w", "n", "f", "b.block", "b.value")
    met = probes.join(_few(index), ["n", "block", "value"]).select("w", "i", "block", F.zip_with("f", "g", lambda a, b: a.bitwiseXOR(b)).alias("x"))
    near = met.filter(F.expr(f"aggregate(x, 0, (s, y) -> s + bit_count(y)) <= {RADIUS}"))
    # a pair that meets in several blocks counts in the first
    return near.filter(F.expr(f"array_position(transform(sequence(0, {BLOCKS - 1}), i -> bit_count({_block('x')}) <= 1), true) = block + 1")).select("w", "i")


def item_shingles(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(i, n, h, w): the shingles of each item (i: its id and text hash) with their weights."""
    named = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("x")).filter("x IS NOT NULL")
    key = F.struct("item", F.xxhash64("x").alias("v")).alias("i")
    rows = common.written(with_shingles(named.distinct(), "x").filter(F.size("hs") > 0).select(key, "n", F.explode(F.array_distinct("hs")).alias("h")))
    weight = rows.groupBy("h").agg((F.lit(1.0) / F.count("*")).alias("w"))
    return common.written(rows.join(weight, "h").select("i", "n", "h", "w"))


def windows(docs: DataFrame, shingles: DataFrame, whole: DataFrame, id_col: str, text: str, least: float) -> DataFrame:
    """(w, n, h, parts): windows (w: document, size and first word) that may leak an item, their first shingle and all they hold of items of their size."""
    owner = F.min(F.xxhash64("i"))
    known = shingles.join(whole.select("i", "total"), "i").groupBy("h", "n").agg(F.first("w").alias("w"), F.min("total").alias("total"), owner.alias("owner"))
    source = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("x")).filter("x IS NOT NULL")
    at = with_shingles(source, "x").select("d", "t", F.posexplode_outer("hs").alias("pos", "h"))  # outer: no filter is inferred that would make the shingles again
    hits = at.join(_few(known), "h").select("d", "t", "n", "pos", "h", "w", "total", "owner").distinct()
    # a window's shingles are fewer than one such unit from its start, whatever its size
    place = F.col("pos") / (F.col("n") - (WORDS - 1)).cast("double")
    ahead = "OVER (PARTITION BY d, t, n ORDER BY place RANGE BETWEEN CURRENT ROW AND 0.9999999D FOLLOWING)"
    spans = hits.withColumn("place", place).select("d", "t", "n", "pos", "h", "total", F.expr(f"sum(w) {ahead}").alias("upto"), F.expr(f"collect_list(struct(h, w, owner)) {ahead}").alias("parts"))
    enough = F.lit(least) * F.col("total") - 1e-9
    near = spans.filter(F.col("upto") >= enough).withColumn("parts", F.array_distinct("parts"))
    return near.filter(_sum(F.col("parts"), lambda p: p["w"]) >= enough).select(F.struct("d", "t", "n", "pos").alias("w"), "n", "h", "parts")


def mixed(parts: Column) -> Column:
    """Whether no item holds ``PURE`` of the window's weight. A shingle that several items hold is counted for one of them."""

    def top(owners: Column) -> Column:
        return F.array_max(F.transform(owners, lambda o: _sum(parts, lambda p: F.when(p["owner"] == o, p["w"]).otherwise(F.lit(0.0)))))

    return common.let(F.array_distinct(F.transform(parts, lambda p: p["owner"])), top) < PURE * _sum(parts, lambda p: p["w"])


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST
) -> DataFrame:
    """(d, t, item, start, similarity): each document (id and text hash) and item that it leaks, with the best window's first word."""
    shingles = item_shingles(items, item_id, item_text)
    whole = shingles.groupBy("i", "n").agg(F.sum("w").alias("total"), F.sort_array(F.collect_list(F.struct("h", "w"))).alias("parts"))
    whole = common.written(whole.select("i", "n", "total", F.transform("parts", lambda p: p["h"]).alias("hs"), fingerprint("parts").alias("g")))

    near = windows(docs, shingles, whole, id_col, text, least)
    near = common.written(near.withColumn("mixed", mixed(F.col("parts"))).withColumn("f", F.when(~F.col("mixed"), fingerprint("parts"))))
    pure = within(near.filter("NOT mixed").select("w", "n", "f"), whole.select("i", "n", "g"))
    rest = near.filter("mixed").select("w", "n", "h").join(_few(shingles.select("n", "h", "i")), ["n", "h"]).select("w", "i")

    pairs = pure.union(rest).join(near.select("w", F.col("h").alias("first"), "parts"), "w").join(_few(whole.select("i", "total", "hs")), "i")
    shared = _sum(F.col("parts"), lambda p: F.when(F.array_contains("hs", p["h"]), p["w"]).otherwise(F.lit(0.0)))
    found = pairs.filter(F.array_contains("hs", F.col("first"))).select("w", "i", F.round(shared / F.col("total"), 6).alias("similarity")).filter(F.col("similarity") >= least)
    best = F.max_by(F.col("w.pos"), F.struct("similarity", -F.col("w.pos")))
    return found.groupBy("w.d", "w.t", "i.item").agg(best.alias("start"), F.max("similarity").alias("similarity"))
