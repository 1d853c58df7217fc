"""Embedding near-dedup: a robust-pruned flat graph over overlapping cluster shards, searched by expanding ranges from medoids.

1. Vectors are normalised in double precision; equal ones form a class with a weight, so copies are never paired. Centroids are fitted on a bounded sample; every vector goes to the shards of its ``overlap``
   nearest centroids. Centroids within the range of each other are one shard, so that a large tight group isn't cut up among its own centroids. A shard that is much larger
   than planned is dealt out as pairs of blocks, so no task holds more than two; such pairs are compared outright, without a graph.
2. Build: in a block, each vector's nearest vectors are its candidates, and robust pruning keeps those that are not nearer to a kept one
   (times ``alpha``) than to the vector; a few edges drawn at random are added. Adjacency lists of one vector from all its shards are united.
3. Search: edges count both ways. In every block pair, every vector is a query. Its greedy search starts at the block's medoids,
   at one vertex of every part of the graph that can't be reached from others (a tight group of copies) and at the query itself where it is
   a vertex, and expands the nearest unexpanded vertex; as soon as a vertex within the range is known, all vertices within the range are expanded, until none is left.
4. Verify: a pair counts if its cosine in double precision reaches the threshold. A pair that meets in several shards counts in
   the first, which both vectors know from their lists of shards. Tasks return counts and a spanning forest, never the pairs.
5. Audit: for a bounded set of queries, half of them drawn from all vectors and half from those with links, the links are counted by brute force
   over all vectors, in blocks. If fewer than ``recall`` of them were found, the build is repeated with one more shard a vector; if ``most_overlap`` shards miss them too, all rows are compared
   outright as pairs of blocks, which finds every link and whose work grows with the square of the rows.

Vectors of different lengths have no cosine: every length is compared by itself; but for the commonest, lengths of fewer than
``block`` vectors are compared outright, all in one go.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; equal ids with different vectors are
different rows; rows equal in id and vector are rows of their own, linked with each other; ids stay integers; other columns aren't read, whatever they
are called; vectors of any length are handled, a block of them at a time; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismframe.llm import common
from prismframe.llm.components import components
from prismframe.llm.ngramjoin import forest


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    shard: int = 350  #: vectors a centroid, planned; each vector is in ``overlap`` shards
    block: int = 2048  #: vectors of a block, at most about
    overlap: int = 3
    most_overlap: int = 8
    sample: int = 20_000  #: vectors that the centroids are fitted on, at most
    most_centroids: int = 2048
    candidates: int = 48
    degree: int = 16
    long: int = 4  #: edges of a vertex to vertices drawn at random: they lead into and out of tight groups
    alpha: float = 1.2
    starts: int = 4  #: medoids of a block that a search starts from
    beam: int = 64  #: expansions of a search before it has reached the range
    audit: int = 200  #: vectors whose links are counted by brute force, at most
    recall: float = 0.98
    seed: int = 5


# ---------------------------------------------------------------- vectors


def unit(rows: list[np.ndarray]) -> np.ndarray:
    return np.array(rows, np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def matrix(arr: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 0))


def vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(r, v, u): a 16-byte key of each row's id and vector, one of its normalised vector, and that; only rows that may link, each as often as it is there. Native."""
    x = F.transform(F.col(f"`{vector}`"), lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(x.alias("x"), row_key(id_col, vector).alias("r")).filter((F.size("x") > 0) & whole)
    top = F.array_max(F.transform("x", lambda e: F.abs(e)))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    scaled = rows.withColumn("top", top).filter("top > 0").select("r", F.transform("x", lambda e: e / F.col("top")).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    unit_ = scaled.withColumn("length", length).select("r", F.transform("x", lambda e: e / F.col("length")).alias("u"))
    return unit_.select("r", _key(F.col("u")).alias("v"), "u")


def _key(*values: Column) -> Column:
    """128 bits of some values."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(*values, F.lit(salt))), 16, "0") for salt in (0, 1))))


def row_key(id_col: str, vector: str) -> Column:
    """What tells rows apart."""
    return _key(F.col(f"`{id_col}`").cast("string"), F.col(f"`{vector}`"))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                mean = own.mean(0)
                centres[c] = mean / max(1e-12, np.linalg.norm(mean))
    return centres


# ---------------------------------------------------------------- graph


def robust_prune(x: np.ndarray, s: Settings) -> list[np.ndarray]:
    """For each vector the places of its neighbours: candidates nearest first, without those that a kept one covers."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    k = min(s.candidates, n - 1)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(cos, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(cos, near, 1)))
    alive, kept, count = np.ones((n, k), bool), np.full((n, s.degree), -1), np.zeros(n, np.int64)
    rows = np.arange(n)
    for at in range(k):
        take = alive[:, at] & (count < s.degree)
        who = rows[take]
        if not len(who):
            continue
        new = near[who, at]
        kept[who, count[who]] = new
        count[who] += 1
        between = np.sqrt(np.maximum(0, 2 - 2 * cos[new[:, None], near[who]]))
        between[near[who] == new[:, None]] = 0
        alive[who] &= ~((s.alpha * between <= far[who]) & (np.arange(k) > at))
    drawn = np.random.default_rng(s.seed).integers(0, n - 1, (n, min(s.long, n - 1)))
    drawn += drawn >= rows[:, None]  # not itself
    return [np.union1d(kept[i, : count[i]], drawn[i]) for i in range(n)]


def pad(lists: list[np.ndarray], least: int = 1) -> np.ndarray:
    """Lists of places as one array; short ones end in -1."""
    width = max([least, *map(len, lists)])
    out = np.full((len(lists), width), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def medoids(x: np.ndarray, n: int) -> np.ndarray:
    """The vector nearest to the mean, then each time the one farthest from those chosen."""
    chosen = [int((x @ x.mean(0)).argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(chosen)


def both_ways(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The lists with every edge in both directions, padded with -1; and one vertex of each connected part."""
    n = len(lists)
    a = np.repeat(np.arange(n), [len(x) for x in lists])
    b = np.concatenate(lists).astype(np.int64) if n else a
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = edges // max(1, n), edges % max(1, n)
    counts = np.bincount(a, minlength=n)
    out = np.full((n, max(1, counts.max(initial=0))), -1, np.int64)
    out[a, np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)] = b
    return out, np.unique(forest(n, a, b))


def range_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, parts: np.ndarray, own: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of every vector that the searches find within the range. All queries take a step at a time.

    ``own`` has the place of a query that is a vertex, else -1. A query expands its nearest unexpanded vertex, ``beam`` times or as long as that vertex is within the range.
    """
    n, m = len(q), len(x)
    cos = np.full((n, m), -3.0, np.float32)  # -3: not seen
    open_ = np.zeros((n, m), bool)
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    start = np.union1d(medoids(x, s.starts), parts)
    cos[:, start] = q32 @ x32[start].T
    open_[:, start] = True
    here = np.flatnonzero(own >= 0)
    cos[here, own[here]], open_[here, own[here]] = 1, True
    wide = s.cosine - 1e-4  # single precision; what is found is verified in double
    expanded = np.zeros(n, np.int64)
    active = np.arange(n)
    while len(active):
        rest = np.where(open_[active], cos[active], -3)
        best = rest.argmax(1)
        top = rest[np.arange(len(active)), best]
        # beyond the beam only vertices within the range go on
        go = (top > -3) & ((top >= wide) | (expanded[active] < s.beam))
        active, best = active[go], best[go]
        if not len(active):
            break
        open_[active, best] = False
        expanded[active] += 1
        more = graph[best]
        who = np.repeat(active, more.shape[1])
        more = more.ravel()
        ok = more >= 0
        who, more = who[ok], more[ok]
        new = cos[who, more] == -3
        who, more = who[new], more[new]
        cos[who, more] = np.einsum("ij,ij->i", q32[who], x32[more])
        open_[who, more] = True
    return np.nonzero(cos >= wide)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal keys, of a sorted stream."""
    key, parts = None, []
    for batch in batches:
        got = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        a = 0
        for b in range(1, len(got) + 1):
            if b == len(got) or got[b] != got[a]:
                if got[a] != key:
                    if parts:
                        yield key, pa.Table.from_batches(parts)
                    key, parts = got[a], []
                parts.append(batch.slice(a, b - a))
                a = b
    if parts:
        yield key, pa.Table.from_batches(parts)


# ---------------------------------------------------------------- the stages


def merged(centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The centroids in the order of their shards, and where each shard's begin: chains of centroids with a cosine of ``least`` are one."""
    root = forest(len(centres), *np.nonzero(np.triu(centres @ centres.T >= least, 1)))
    order = np.argsort(root, kind="stable")
    return centres[order], np.unique(root[order], return_index=True)[1]


def shards(rows: DataFrame, n: int, overlap: int, s: Settings) -> DataFrame:
    """(v, u, weight, shards): each class with the shards of its nearest centroids, in ascending order."""
    rng = np.random.default_rng(s.seed)
    share = min(1.0, 1.2 * s.sample / max(1, n))
    uniform = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = sorted((bytes(r["v"]), r["u"]) for r in rows.filter(uniform <= share).select("v", "u").limit(2 * s.sample).toLocalIterator())
    sample = unit([u for _, u in got[: s.sample]])
    k = max(1, min(s.most_centroids, math.ceil(n / s.shard), len(sample)))
    centres = k_means(sample, k, rng) if len(sample) else np.zeros((1, 1))
    centres, starts = merged(centres, s.cosine)
    where = rows.sparkSession.sparkContext.broadcast((centres, starts))  # most_centroids vectors at most
    take = min(overlap, len(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            centres, starts = where.value
            near = np.maximum.reduceat(matrix(b.column(1)) @ centres.T, starts, axis=1)
            best = np.sort(np.argpartition(-near, take - 1, axis=1)[:, :take], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], names=["v", "u", "weight", "shards"])

    return common.written(rows.select("v", "u", "weight").mapInArrow(run, "v binary, u array<double>, weight long, shards array<int>"))


def build(placed: DataFrame, s: Settings) -> DataFrame:
    """(v, near): the adjacency lists of every vector, united over its shards of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches, ("shard", "side")):
            ids = np.array(t.column("v").to_pylist(), object)
            lists = robust_prune(matrix(t.column("u").combine_chunks()), s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([ids[x].tolist() for x in lists], pa.list_(pa.binary()))], names=["v", "near"])

    lists = placed.filter("blocks = 1").select("shard", "side", "v", "u").repartition("shard", "side").sortWithinPartitions("shard", "side", "v").mapInArrow(run, "v binary, near array<binary>")
    return common.written(lists.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))


def _by_graph(ids: list, x: np.ndarray, side: np.ndarray, near: list, i: int, j: int, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that the searches of a block pair find, once each."""
    left, right = [], []
    for a, b in {(i, j), (j, i)}:
        q, base = np.flatnonzero(side == a), np.flatnonzero(side == b)
        if not len(q) or not len(base):
            continue
        place = {ids[r]: k for k, r in enumerate(base.tolist())}
        own = np.array([place.get(ids[r], -1) for r in q.tolist()])
        lists, parts = both_ways([np.array([place[o] for o in near[r] if o in place], np.int64) for r in base.tolist()])
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            f, g = range_search(x[part], x[base], lists, parts, own[lo : lo + 512], s)
            left.append(part[f])
            right.append(base[g])
    left, right = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (left, right))
    pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1)[left != right], axis=0)
    yield pairs[:, 0], pairs[:, 1]


def _outright(x: np.ndarray, side: np.ndarray, i: int, j: int, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of a block pair that may be within the range, once each, some rows at a time."""
    q, base = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for lo in range(0, len(q), 128):
        left, right = np.nonzero(x[q[lo : lo + 128]] @ x[base].T >= s.cosine - 1e-9)  # the caller verifies
        left, right = q[lo + left], base[right]
        ok = (left < right) | (i != j)
        yield left[ok], right[ok]


def search(placed: DataFrame, graph: DataFrame | None, s: Settings) -> DataFrame:
    """(v, links, root) of vectors with links, one row a block pair. Shards of several blocks, and without a graph all, are compared outright."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, i, j, outright), t in _groups(batches, ("shard", "i", "j", "outright")):
            ids, x = t.column("v").to_pylist(), matrix(t.column("u").combine_chunks())
            side = t.column("side").to_numpy()
            weight = t.column("weight").to_numpy()
            homes = pad([np.array(h) for h in t.column("shards").to_pylist()])
            links, found = np.zeros(len(ids), np.int64), []
            for left, right in _outright(x, side, i, j, s) if outright else _by_graph(ids, x, side, t.column("near").to_pylist(), i, j, s):
                # the first shard that both are in counts the pair
                first = np.full(len(left), np.iinfo(np.int64).max)
                for c in range(homes.shape[1]):
                    both = (homes[left, c][:, None] == homes[right]).any(axis=1)
                    first = np.where(both, np.minimum(first, homes[left, c]), first)
                ok = first == shard
                left, right = left[ok], right[ok]
                ok = np.einsum("ij,ij->i", x[left], x[right]) >= s.cosine
                left, right = left[ok], right[ok]
                links += np.bincount(left, weight[right], len(ids)).astype(np.int64) + np.bincount(right, weight[left], len(ids)).astype(np.int64)
                root = forest(len(ids), left, right)
                has = np.flatnonzero(root != np.arange(len(ids)))
                found.append((has, root[has]))  # a forest, not the pairs
            left, right = (np.concatenate(p) for p in zip((np.zeros(0, np.int64),) * 2, *found, strict=True))
            root = forest(len(ids), left, right)
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in has], pa.binary()), pa.array(links[has], pa.int64()), pa.array([ids[root[k]] for k in has], pa.binary())], names=["v", "links", "root"]
            )

    rows = placed if graph is None else placed.join(graph, "v", "left")
    rows = rows.withColumns({"near": F.lit(None).cast("array<binary>")} if graph is None else {}).withColumn("outright", F.lit(graph is None) | (F.col("blocks") > 1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shard", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "v", "u", "weight", "shards", F.when(~F.col("outright"), F.col("near")).alias("near"), "outright")
    rows = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "side", "v")
    return common.written(rows.mapInArrow(run, "v binary, links long, root binary"))


def in_blocks(rows: DataFrame, s: Settings) -> DataFrame:
    """A row for each shard of a vector, with its block there (``side``) and the shard's number of ``blocks``."""
    placed = rows.select("v", "u", "weight", "shards", F.explode("shards").alias("shard"))
    per = placed.groupBy("shard").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / s.block).cast("int")
    placed = placed.join(F.broadcast(per), "shard")  # a row a centroid
    return placed.select("shard", "v", "u", "weight", "shards", blocks.alias("blocks"), F.pmod(F.xxhash64("v"), blocks).cast("int").alias("side"))


def audit(rows: DataFrame, counts: DataFrame, n: int, s: Settings) -> float:
    """The found share of the links of a bounded set of vectors, counted by brute force over all.

    Where near copies are rare, few of the vectors drawn from all have a link; those with links are drawn from too, and tell whether all of theirs were found.
    """
    uniform = F.pmod(F.xxhash64("v", F.lit(s.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    linked = counts.select("v")
    asked = []
    for pool, size in ((rows, n), (rows.join(linked, "v", "left_semi"), linked.count())):
        some = pool.filter(uniform <= min(1.0, s.audit / max(1, size))).select("v", "u", "weight")
        asked += [r for r in some.orderBy(uniform, "v").limit(2 * s.audit).collect() if r["v"] not in {x["v"] for x in asked}]
    if not asked:
        return 1.0
    where = rows.sparkSession.sparkContext.broadcast((unit([r["u"] for r in asked]), s.cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = where.value
        true = np.zeros(len(q), np.int64)
        for b in batches:
            if b.num_rows:
                x, weight = matrix(b.column(0)), b.column(1).to_numpy()
                for lo in range(0, len(x), 4096):
                    true += (q @ x[lo : lo + 4096].T >= least) @ weight[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(true)], names=["q", "n"])

    true = rows.select("u", "weight").mapInArrow(run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in true) - sum(r["weight"] for r in asked)  # each class meets itself
    found = counts.filter(F.col("v").isin([bytes(r["v"]) for r in asked])).agg(F.sum("links")).first()[0] or 0
    return found / total if total else 1.0


def links_of_length(rows: DataFrame, n: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(v, links, root) of vectors of one length with links, and (v, links) summed."""
    overlap = s.overlap
    while True:
        placed = in_blocks(shards(rows, n, overlap, s), s)
        links = search(placed, build(placed, s), s)
        counts = common.written(links.groupBy("v").agg(F.sum("links").alias("links")))
        if audit(rows, counts, n, s) >= s.recall:
            return links, counts
        if overlap >= s.most_overlap:  # shards don't find the links: one shard of all rows does
            return outright(rows.withColumn("shards", F.array(F.lit(0))), s)
        overlap += 1


def outright(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The same of vectors (with their ``shards``) that are compared pair by pair inside a shard."""
    links = search(in_blocks(rows, s), None, s)
    return links, common.written(links.groupBy("v").agg(F.sum("links").alias("links")))


def dedup(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """(id, n_links, component_id, kept), one row a row."""
    members = common.written(vectors(df, id_col, vector))
    every = df.select(F.col(f"`{id_col}`").alias("d"), row_key(id_col, vector).alias("r"))
    rows = common.written(members.groupBy("v").agg(F.first("u").alias("u"), F.count("*").alias("weight")).withColumn("size", F.size("u")))
    per = rows.groupBy("size").agg(F.count("*").alias("n"))
    commonest = per.orderBy(F.desc("n"), "size").limit(1)
    sizes = {r["size"]: r["n"] for r in per.filter(F.col("n") >= s.block).union(commonest).collect()}
    # other lengths have few vectors: the length is the shard
    rare = rows.filter(~F.col("size").isin(list(sizes))) if sizes else rows
    found = [outright(rare.withColumn("shards", F.array("size")), s)]
    found += [links_of_length(rows.filter(F.col("size") == size), n, s) for size, n in sorted(sizes.items())]
    links, counts = found[0]
    for more, sums in found[1:]:
        links, counts = links.union(more), counts.union(sums)
    labels = components(links.select(F.col("v").alias("a"), F.col("root").alias("b")))
    known = rows.select("v", "weight").join(counts, "v", "left").join(labels, "v", "left")
    known = common.written(known.select("v", F.coalesce("label", "v").alias("label"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # tables of their own, so that the joins read exchanges on both sides and a large class or component can be split
    own = common.written(members.select("r", "v").distinct().join(known, "v").drop("v"))
    placed = common.written(every.join(own, "r", "left").withColumn("label", F.coalesce("label", "r")).drop("r"))
    first = common.written(placed.groupBy("label").agg(F.min("d").alias("component_id")))
    return placed.join(first, "label").select(
        F.col("d").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("d").eqNullSafe(F.col("component_id")).alias("kept")
    )
