"""Hash trees: bucket statistics, best splits, learners, codes, and the tree product quantiser (MIT01-MIT03, MIT05-MIT20, FLT06)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators import linalg
from prismframe.operators.arrow import partial_sums

# ---------------------------------------------------------------- distributed statistics


def bucket_stats(coded: DataFrame, node: str, vector: str) -> DataFrame:
    """MIT01: (node, pos, n, sum, sum2, loss): the loss is the sum of squared deviations in a node and position."""
    flat = coded.select(F.col(node).alias("node"), F.posexplode(vector).alias("pos", "x")).select("node", "pos", F.col("x").cast("double").alias("x"))
    out = flat.groupBy("node", "pos").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sum2"))
    return out.withColumn("loss", F.col("sum2") - F.col("sum") * F.col("sum") / F.col("n"))


def below(rows: DataFrame, vector: str, dim: int, value: float) -> DataFrame:
    """FLT06: the rows that a cut sends to its lower side."""
    return rows.filter(F.col(vector)[dim] < value)


def best_splits(rows: DataFrame, node: str, x: str) -> DataFrame:
    """MIT02: (node, value, loss): the cut of a node's values with the least squared error on both sides, half way between neighbours.

    Equal values are never cut apart; of equal losses the lower cut counts. A node with one value has no cut.
    """
    v = F.col(x).cast("double")
    # counted by value first, with partial sums before the shuffle
    held = rows.filter(v.isNotNull()).select(F.col(node).alias("node"), v.alias("x")).groupBy("node", "x").agg(F.count("*").alias("k"))
    order, whole = Window.partitionBy("node").orderBy("x"), Window.partitionBy("node")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    k, s, s2 = F.col("k"), F.col("k") * F.col("x"), F.col("k") * F.col("x") * F.col("x")
    t = held.select(
        "node", "x",
        F.sum(k).over(up).alias("n"), F.sum(s).over(up).alias("s"), F.sum(s2).over(up).alias("s2"),
        F.sum(k).over(whole).alias("all_n"), F.sum(s).over(whole).alias("all_s"), F.sum(s2).over(whole).alias("all_s2"),
        F.lead("x").over(order).alias("next"),
    ).filter(F.col("next") > F.col("x"))
    left = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    rest = F.col("all_s") - F.col("s")
    right = F.col("all_s2") - F.col("s2") - rest * rest / (F.col("all_n") - F.col("n"))
    t = t.select("node", ((F.col("x") + F.col("next")) / 2).alias("value"), F.round(left + right, 9).alias("loss"))
    return t.groupBy("node").agg(F.min(F.struct("loss", "value")).alias("b")).select("node", F.col("b.value").alias("value"), F.col("b.loss").alias("loss"))


# ---------------------------------------------------------------- learners, on a bounded sample


def _cut(x: np.ndarray, at: int) -> tuple[float, float]:
    """(value, loss) of the best cut of a node's rows along a column; the loss counts all columns."""
    if len(x) < 2:
        return (float(x[0, at]) if len(x) else 0.0), 0.0
    order = np.argsort(x[:, at], kind="stable")
    s = x[order]
    n = np.arange(1, len(s) + 1)[:, None]

    def sse(z: np.ndarray) -> np.ndarray:
        a, b = np.cumsum(z, 0), np.cumsum(z * z, 0)
        return (b - a * a / n).sum(1)

    head, tail = sse(s), sse(s[::-1])[::-1]
    total = np.append(head[:-1] + tail[1:], np.inf)
    total[:-1][s[1:, at] <= s[:-1, at]] = np.inf  # equal values stay together
    i = int(total.argmin())
    if not np.isfinite(total[i]):
        return float(s[-1, at]), float(head[-1])
    return float((s[i, at] + s[i + 1, at]) / 2), float(total[i])


def learn_tree(x: np.ndarray, levels: int = 4, tries: int = 4, dims: range | None = None, quantized: bool = False) -> list[dict]:
    """MIT03: level by level, the dimension whose own best cuts leave the least loss, among the ``tries`` of ``dims`` with the largest loss in all nodes.

    With ``quantized`` a level's values become integers of 0 to 255 behind an offset and a power-of-two scale.
    """
    dims = dims or range(x.shape[1])
    codes, out = np.zeros(len(x), np.int64), []
    for level in range(levels):
        nodes = [x[codes == g] for g in range(2**level)]
        rank = np.asarray(sum(v.var(0) * len(v) for v in nodes if len(v)))
        picked = sorted(dims, key=lambda j: (-rank[j], j))[:tries]
        cuts = {j: [_cut(v, j) for v in nodes] for j in picked}
        dim = min(picked, key=lambda j: (sum(loss for _, loss in cuts[j]), j))
        step = {"dim": int(dim), "vals": [v for v, _ in cuts[dim]], "offset": 0.0, "scale": 1.0}
        if quantized:
            low = (x[:, dim].min() + min(step["vals"])) / 2
            high = (x[:, dim].max() + max(step["vals"])) / 2 - low
            scale = 2.0 ** math.trunc(math.log2(254 / high)) if high > 0 else 1.0
            step |= {"vals": [float(int(np.clip((v - low) * scale, 0, 255))) for v in step["vals"]], "offset": float(low), "scale": scale}
        out.append(step)
        codes = 2 * codes + ((x[:, dim] - step["offset"]) * step["scale"] > np.array(step["vals"])[codes])
    return out


def learn_splits(x: np.ndarray, n: int, how: str = "greedy", at: str = "mean") -> list[tuple[int, float]]:
    """MIT05: n single thresholds. ``simple`` takes the dimensions of most variance; ``conditional`` the one of most variance inside the
    cells so far; ``greedy`` the one whose cut leaves the least loss inside the cells."""
    out: list[tuple[int, float]] = []
    cells = np.zeros(len(x), np.int64)
    middle = np.median if at == "median" else np.mean
    order = np.argsort(-x.var(0), kind="stable")
    for i in range(n):
        groups = [x[cells == g] for g in np.unique(cells)]
        if how == "simple":
            dim = int(order[i % len(order)])
            val = float(middle(x[:, dim]))
        elif how == "conditional":
            dim = int(sum(g.var(0) * len(g) for g in groups).argmax())
            val = float(middle(x[:, dim]))
        else:
            vals = middle(x, axis=0)
            loss = np.zeros(x.shape[1])
            for g in groups:
                for j in range(x.shape[1]):
                    over = g[:, j] > vals[j]
                    loss[j] += sum(p.var(0).sum() * len(p) for p in (g[over], g[~over]) if len(p))
            dim = int(loss.argmin())
            val = float(vals[dim])
        out.append((dim, val))
        cells = cells * 2 + (x[:, dim] > val)
    return out


def tree_codes(x: np.ndarray, levels: list[dict]) -> np.ndarray:
    g = np.zeros(len(x), np.int64)
    for s in levels:
        g = 2 * g + ((x[:, s["dim"]] - s.get("offset", 0.0)) * s.get("scale", 1.0) > np.array(s["vals"])[g])
    return g


# ---------------------------------------------------------------- one-hot products (MIT14)


def _codebooks(coded: DataFrame, codes_col: str) -> int:
    one = coded.filter(F.col(codes_col).isNotNull()).select(F.size(codes_col).alias("n")).first()
    return 0 if one is None else one["n"]


def onehot_gram(codes: DataFrame, codes_col: str = "codes", k: int = 16) -> DataFrame:
    """X'X of one-hot codes: (c1, k1, c2, k2, n): how often two codes meet in a row. A product a batch, one partial sum a task."""
    n = _codebooks(codes, codes_col)

    def product(c: list[np.ndarray]) -> np.ndarray:
        hot = gram_dense(c[0].astype(np.int64), k).astype(np.float32)  # counts of a batch are exact
        return hot.T @ hot

    got = partial_sums(codes.filter(F.col(codes_col).isNotNull()), [codes_col], product, (n * k, n * k)).filter("x > 0")
    row, col = F.floor(F.col("at") / (n * k)), F.col("at") % max(1, n * k)
    place = lambda x, i: [F.floor(x / k).cast("int").alias(f"c{i}"), (x % k).cast("int").alias(f"k{i}")]
    return got.select(*place(row, 1), *place(col, 2), F.round("x").cast("long").alias("n"))


def onehot_xty(coded: DataFrame, codes_col: str, target: str, k: int = 16) -> DataFrame:
    """X'Y: (c, k, m, s): the sum of target m over the rows of each code that occurs."""
    rows = coded.filter(F.col(codes_col).isNotNull() & F.col(target).isNotNull())
    n, m = _codebooks(rows, codes_col), _codebooks(rows, target)
    got = partial_sums(rows, [codes_col, target], lambda c: gram_dense(c[0].astype(np.int64), k).T @ np.hstack([c[1], np.ones((len(c[1]), 1))]), (n * k, m + 1))
    cells = got.select(F.floor(F.col("at") / (m + 1)).alias("r"), (F.col("at") % (m + 1)).cast("int").alias("m"), "x")
    there = F.broadcast(cells.filter((F.col("m") == m) & (F.col("x") > 0)).select("r"))  # a row a code of the model
    return cells.filter(F.col("m") < m).join(there, "r").select(F.floor(F.col("r") / k).cast("int").alias("c"), (F.col("r") % k).cast("int").alias("k"), "m", F.col("x").alias("s"))


def onehot_lookup_sum(codes: Column, weights: np.ndarray, n: int, k: int) -> Column:
    """XW as a column: for each output the sum of the rows' weights; ``weights`` is (n * k, outputs)."""
    return F.array(*(V.lut_sum(codes, V.literal(weights[:, m]), n, k) for m in range(weights.shape[1])))


def gram_dense(codes: np.ndarray, k: int) -> np.ndarray:
    n = codes.shape[1]
    hot = np.zeros((len(codes), n * k))
    hot[np.arange(len(codes))[:, None], codes + np.arange(n) * k] = 1
    return hot


def sparse_ridge(xx: np.ndarray, xy: np.ndarray, n: int, k: int, spans: list[tuple[int, int]], nnz: int, lam: float = 1.0, how: str = "eliminate") -> np.ndarray:
    """MIT15: for every codebook only some output dimensions: its own span and those of the largest coefficients, ``nnz`` in all.

    ``eliminate`` drops all others at once and refits; ``pursuit`` adds dimensions one by one by the largest correlation of what is left;
    ``backward`` drops them one by one by the smallest norm, refitting each time.
    """
    dims = xy.shape[1]
    w = linalg.ridge(xx, xy, lam)
    keep = np.zeros((n, dims), bool)
    for c, (a, b) in enumerate(spans):
        keep[c, a:b] = True

    def refit(mask: np.ndarray) -> np.ndarray:
        out = np.zeros_like(w)
        for m in range(dims):
            rows = np.flatnonzero(np.repeat(mask[:, m], k))
            if len(rows):
                out[rows, m] = linalg.ridge(xx[np.ix_(rows, rows)], xy[rows, m], lam)
        return out

    def norms(z: np.ndarray) -> np.ndarray:
        return np.sqrt((z.reshape(n, k, dims) ** 2).sum(1))

    if how == "pursuit":
        while keep.sum(1).min() < min(nnz, dims):
            left = norms(xy - xx @ refit(keep))
            for c in range(n):
                if keep[c].sum() < nnz:
                    keep[c, np.where(keep[c], -1, left[c]).argmax()] = True
        return refit(keep)
    if how == "backward":
        mask = np.ones((n, dims), bool)
        while mask.sum(1).max() > max(nnz, int(keep.sum(1).max())):
            size = norms(refit(mask))
            for c in range(n):
                if mask[c].sum() > max(nnz, int(keep[c].sum())):
                    mask[c, np.where(mask[c] & ~keep[c], size[c], np.inf).argmin()] = False
        return refit(mask)
    size = norms(w)
    for c in range(n):
        for m in np.argsort(-np.where(keep[c], -1, size[c]), kind="stable")[: max(0, nnz - int(keep[c].sum()))]:
            keep[c, m] = True
    return refit(keep)


# ---------------------------------------------------------------- the tree product quantiser


@dataclass
class TreeModel:
    """MIT12, MIT13, MIT20: a tree for each codebook, means of the residual in its leaves, and full-width centroids refitted by ridge regression."""

    trees: list[list[dict]]
    centroids: np.ndarray  # (codebooks, 16, D)

    @classmethod
    def learn(cls, x: np.ndarray, n: int, spans: list[tuple[int, int]], work: float = -1, lam: float = 1.0, quantized: bool = False) -> TreeModel:
        """``work``: -1 refits all coefficients, 1 none, more than 1 that many times D / n dimensions of a codebook. Splits are on the codebook's own span."""
        dim = x.shape[1]
        left, trees, cents = x.copy(), [], np.zeros((n, 16, dim))
        for c, (a, b) in enumerate(spans):
            own = range(a, b)
            # splits are learned on the vectors themselves, as codes are made from those; the means are of what is left
            t = learn_tree(x, 4, 4, own, quantized)
            codes = tree_codes(x, t)
            for g in range(16):
                rows = left[codes == g]
                if len(rows):
                    cents[c, g, list(own)] = rows[:, list(own)].mean(0)
            left = left - cents[c][codes]
            trees.append(t)
        if work != 1:
            codes = np.stack([tree_codes(x, t) for t in trees], 1)
            hot = gram_dense(codes, 16)
            if work < 0:
                w = linalg.ridge(hot.T @ hot, hot.T @ left, lam)
            else:
                w = sparse_ridge(hot.T @ hot, hot.T @ left, n, 16, spans, max(1, int(work * dim / n)), lam)
            cents = cents + w.reshape(n, 16, dim)
        return cls(trees, cents)

    def codes(self, v: Column) -> Column:
        """MIT09: four comparisons a codebook, in the JVM; only the split dimensions are read."""
        return F.array(*(V.tree_code(v, t) for t in self.trees))

    def luts(self, q: np.ndarray) -> np.ndarray:
        """MIT16: (queries, codebooks, 16)."""
        return np.einsum("qd,ckd->qck", q, self.centroids)
