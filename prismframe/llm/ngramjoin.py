"""N-gram Jaccard join by chosen paths: sets split recursively on sampled shared tokens, small buckets compared outright.

A document is the set of its five-word shingles (whitespace-separated words, A-Z lower-cased). Documents with equal sets form a class; the
join runs over classes, and copies are never paired. In each run a random priority orders all shingles; a set's path is its
first, second, ... shingle in that order. Sets that share the first shingle are a bucket; a bucket of more than ``limit`` classes is split
by the next shingle, and so on down to ``depth``. Two sets of similarity s share a path of length l with probability about s ** l,
so ``runs`` independent runs miss a pair at the threshold t with probability (1 - t ** depth) ** runs at worst; the number of runs
follows from the target recall. Pairs in shallow buckets, that is nearly all, are found almost surely: (1 - t) ** runs.

Buckets are compared exactly, from the whole sets. One that is still large at the last level (a group of near copies can't be
split by shared tokens) is dealt out as pairs of blocks of ``block`` classes; a task holds two blocks and counts intersections by
products of incidence matrices. A pair that meets in several runs counts in the first, which both rows know from their lists of
buckets. Tasks return counts and a spanning forest of the links they found, never the pairs.

Defined results: a null text is empty; texts without words are alone and have no links; a text of one to four words is one
shingle; rows equal in id and text are one document; the smallest id of a group is its class id and is kept (of equal ids with
different texts one is). A very long text is a piece of its own, whose working arrays take some 60 bytes a byte; of other columns none is read,
whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.llm import common
from prismframe.llm.components import components

WORDS = 5


@dataclass(frozen=True)
class Settings:
    num: int = 4  #: the threshold is num / den
    den: int = 5
    depth: int = 3
    limit: int = 32
    recall: float = 0.9999
    block: int = 256
    seed: int = 20_011

    @property
    def runs(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - (self.num / self.den) ** self.depth))


# ---------------------------------------------------------------- shingles


def _byte_values() -> np.ndarray:
    return common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(BASE, -1, 1 << 64)
_FACTORS = tuple(int(x) | 1 for x in common.mix64(np.arange(11, 11 + WORDS, dtype=np.uint64)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(arr: pa.Array) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles."""
    data, offsets = common.utf8(arr)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    n = len(data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]] if n else [gap]) | (~gap & edge[:n]))
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]] if n else [gap]) | edge[1:])) + 1
    # a word's hash from prefix sums of byte values times powers of an odd base, moved to the word's start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[data] * _powers(BASE, n), dtype=np.uint64)])
    word = common.mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    m = max(0, len(word) - WORDS + 1)
    mixed = np.zeros(m, np.uint64)
    for k, f in enumerate(_FACTORS):
        mixed += word[k : k + m] * np.uint64(f)
    mixed = common.mix64(mixed)
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(mixed[a : b - WORDS + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for k in range(a, b):
                whole = common.mix64(np.array([whole ^ word[k]]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(tokens: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order of its tokens."""
    sums = [int(common.mix64(tokens ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.array(sums, np.uint64).tobytes()


def paths(tokens: np.ndarray, s: Settings) -> np.ndarray:
    """(runs * depth): for each run the hashes of its path's prefixes; a set that ends sooner repeats its last one."""
    salts = common.mix64(np.arange(s.seed, s.seed + s.runs, dtype=np.uint64))
    order = common.mix64(tokens[None, :] ^ salts[:, None])
    d = min(s.depth, len(tokens))
    if len(tokens) > 4 * d:
        order = np.partition(order, d - 1, axis=1)[:, :d]
    order = np.sort(order, axis=1)[:, :d]
    out, at = np.empty((s.runs, s.depth), np.uint64), salts
    for k in range(s.depth):
        if k < d:
            at = common.mix64(at * np.uint64(0x9E3779B97F4A7C15) ^ order[:, k])
        out[:, k] = at
    return out.reshape(-1).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text: str, s: Settings) -> DataFrame:
    """(d, t, c, paths) of every document; c, the class, is null without words."""

    def fn(arr: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(arr)
        return [
            pa.array([class_key(x) if len(x) else None for x in sets], pa.binary()),
            pa.array([paths(x, s) if len(x) else None for x in sets], pa.list_(pa.int64())),
        ]

    rows = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("x"))
    out = [T.StructField("c", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType()))]
    return common.map_text(rows, "x", ["d", "t"], out, fn)


# ---------------------------------------------------------------- buckets


def buckets(classes: DataFrame, s: Settings) -> DataFrame:
    """(c, run, bucket, n): where each class is compared; n classes share the bucket. Classes alone in theirs don't appear."""
    prefix = [F.element_at("paths", F.col("run") * s.depth + k + 1).alias(f"p{k}") for k in range(s.depth)]
    rest = classes.select("c", "paths", F.explode(F.sequence(F.lit(0), F.lit(s.runs - 1))).alias("run")).select("c", "run", *prefix)
    done = []
    for k in range(s.depth):
        # a table of its own, so that the join reads exchanges on both sides and a hot bucket can be split
        counts = common.written(rest.groupBy(f"p{k}").agg(F.count("*").alias("n")).filter("n > 1"))
        level = common.written(rest.join(counts, f"p{k}"))
        last = k == s.depth - 1
        done.append(level.filter(F.lit(last) | (F.col("n") <= s.limit)).select("c", "run", F.col(f"p{k}").alias("bucket"), "n"))
        rest = level.filter(F.col("n") > s.limit).drop("n")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def useful(entries: DataFrame, s: Settings) -> DataFrame:
    """(c, homes, visits): for each class its bucket in every run (0 for none), and the buckets in which it must be compared.

    A bucket whose classes all share one bucket of an earlier run can hold no new pair, so nothing is sent there.
    """
    listed = entries.groupBy("c").agg(F.collect_list(F.struct("run", "bucket")).alias("l"))
    home = F.transform(
        F.sequence(F.lit(0), F.lit(s.runs - 1)), lambda r: F.coalesce(F.get(F.filter("l", lambda h: h["run"] == r), F.lit(0))["bucket"], F.lit(0).cast("long"))
    )
    placed = common.written(entries.join(listed.select("c", home.alias("homes")), "c"))
    known = F.lit(False)
    spans = [f(F.element_at("homes", r + 1)).alias(f"{n}{r}") for r in range(s.runs - 1) for n, f in (("low", F.min), ("high", F.max))]
    for r in range(s.runs - 1):
        known = known | ((F.col("run") > r) & (F.col(f"low{r}") == F.col(f"high{r}")) & (F.col(f"low{r}") != 0))
    fresh = common.written(placed.groupBy("run", "bucket").agg(*spans).filter(~known).select("run", "bucket"))
    return placed.join(fresh, ["run", "bucket"]).groupBy("c").agg(F.first("homes").alias("homes"), F.collect_list(F.struct("run", "bucket", "n")).alias("visits"))


# ---------------------------------------------------------------- comparing


def intersections(sets: list[np.ndarray], cells: int = 4 << 20) -> np.ndarray:
    """How many tokens each two sets share, by products of incidence matrices of at most ``cells`` cells."""
    m = len(sets)
    if m == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    used = shared[place]
    place, owner = column[place[used]], owner[used]
    out, width, total = np.zeros((m, m), np.float64), max(1, cells // m), int(shared.sum())
    by = np.argsort(place, kind="stable")
    place, owner = place[by], owner[by]
    for a in range(0, total, width):
        lo, hi = np.searchsorted(place, [a, a + width])
        cell = np.zeros((m, min(width, total - a)), np.float32)
        cell[owner[lo:hi], place[lo:hi] - a] = 1
        out += cell @ cell.T
    return np.rint(out).astype(np.int64)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest vertex joined with each of n vertices."""
    at = np.arange(n)
    while len(left):
        low = np.minimum(at[left], at[right])
        new = at.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, at[left], low)
        np.minimum.at(new, at[right], low)
        new = new[new]
        if (new == at).all():
            break
        at = new
    return at


def compare(run: int, cross: bool, sides: np.ndarray, weights: np.ndarray, homes: np.ndarray, sets: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The links of a bucket's block pair that no earlier run has: for each row its weighted number, and its root in their forest.

    ``sides`` is each row's block. ``homes`` (rows, runs) has each row's bucket in every run, 0 for none.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    both = intersections(sets)
    link = (s.num + s.den) * both >= s.num * (size[:, None] + size[None, :])
    left, right = np.nonzero(np.triu(link, 1))
    fresh = (sides[left] != sides[right]) == cross
    left, right = left[fresh], right[fresh]
    if run and len(left):
        known = ((homes[left, :run] == homes[right, :run]) & (homes[left, :run] != 0)).any(axis=1)
        left, right = left[~known], right[~known]
    links = np.zeros(m, np.int64)
    np.add.at(links, left, weights[right])
    np.add.at(links, right, weights[left])
    return links, forest(m, left, right)


def compare_sorted(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (run, bucket, i, j): each such group is compared; (c, links, root) of rows that have links."""
    key, group, found = None, [], []

    def finish() -> None:
        if len(group) > 1:
            run, _, i, j = key
            homes = np.array([g[3] for g in group], np.int64)
            links, root = compare(run, i != j, np.array([g[1] for g in group]), np.array([g[2] for g in group], np.int64), homes, [g[4] for g in group], s)
            found.extend((group[k][0], int(links[k]), group[root[k]][0]) for k in np.flatnonzero(links))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], names=["c", "links", "root"]
        )
        found.clear()
        return out

    for batch in batches:
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        keys = list(zip(*(cols[k].to_pylist() for k in ("run", "bucket", "i", "j")), strict=True))
        cs, sides, weights = (cols[k].to_pylist() for k in ("c", "side", "size"))
        homes = cols["homes"].to_pylist()
        for row, k in enumerate(keys):
            if k != key:
                finish()
                key, group = k, []
            if group and group[-1][0] == cs[row]:
                continue  # rows equal in id and text are read once each
            group.append((cs[row], sides[row], weights[row], homes[row], np.frombuffer(cols["tokens"][row].as_py(), np.uint64)))
        if len(found) >= 4096:
            yield flush()
    finish()
    yield flush()


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(d, t, class_id, n_links, kept), one row a document: links are other documents of similarity num / den or more."""
    signed = common.written(signatures(docs, id_col, text, s).dropDuplicates(["d", "t"]))
    classes = signed.filter("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("d", "t")).alias("rep"), F.count("*").alias("size"), F.first("paths").alias("paths"))
    classes = common.written(classes)
    visits = useful(buckets(classes.select("c", "paths"), s), s)
    wanted = classes.drop("paths").join(visits, "c").select("c", "size", "homes", "visits", F.col("rep.d").alias("rd"), F.col("rep.t").alias("rt"))

    source = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("x"))
    texts = source.join(wanted, F.col("d").eqNullSafe(F.col("rd")) & (F.col("t") == F.col("rt"))).drop("d", "t", "rd", "rt")
    tokens = common.map_text(
        texts, "x", ["c", "size", "homes", "visits"], [T.StructField("tokens", T.BinaryType())], lambda arr: [pa.array([x.tobytes() for x in shingle_sets(arr)], pa.binary())]
    )
    dealt = tokens.select("c", "size", "tokens", "homes", F.explode("visits").alias("h"))
    blocks = F.ceil(F.col("h.n") / s.block).cast("int")
    dealt = dealt.select(
        F.col("h.run").alias("run"), F.col("h.bucket").alias("bucket"), "c", "size", "homes", "tokens", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("side"), blocks.alias("blocks")
    )
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "run", "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "c", "size", "homes", "tokens"
    ).repartition("run", "bucket", "i", "j")
    dealt = dealt.sortWithinPartitions("run", "bucket", "i", "j", "c")
    links = common.written(dealt.mapInArrow(lambda it: compare_sorted(it, s), "c binary, links long, root binary"))

    counts = links.groupBy("c").agg(F.sum("links").alias("links"))
    labels = components(links.select(F.col("c").alias("a"), F.col("root").alias("b")))
    known = classes.select("c", "size").join(counts, "c", "left").join(labels.withColumnRenamed("v", "c"), "c", "left")
    known = known.select("c", F.coalesce("label", "c").alias("label"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    members = common.written(signed.select("d", "t", "c").join(common.written(known), "c", "left"))
    first = common.written(members.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("d", "t")).alias("first")))
    return members.join(first, "label", "left").select(
        "d", "t",
        F.when(F.col("first").isNull(), F.col("d")).otherwise(F.col("first.d")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("first").isNull() | (F.col("first") == F.struct("d", "t"))).alias("kept"),
    )
