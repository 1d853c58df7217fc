"""Codebooks: per-subspace k-means, one distributed Lloyd step, centroid updates, rotations learned with them (TRN01-TRN08, TRN14-15)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators import linalg
from prismframe.operators.arrow import partial_sums


def sq_dists(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 16, seed: int = 0, init: str = "++") -> tuple[np.ndarray, np.ndarray]:
    """(centroids, codes) of a sample. Fewer distinct non-zero rows than k: those rows, then zeros. A centroid left empty keeps its place.

    ``init="subspaces"`` seeds with the products of halves' own centroids.
    """
    distinct = np.unique(x[np.abs(x).sum(1) > 0], axis=0) if len(x) else x
    if len(distinct) <= k:
        c = np.zeros((k, x.shape[1]))
        c[: len(distinct)] = distinct
        return c, sq_dists(x, c).argmin(1)
    rng = np.random.default_rng(seed)
    half = x.shape[1] // 2
    root = int(round(k**0.5))
    if init == "subspaces" and half and root * root == k:
        a, b = (kmeans(part, root, rounds, seed)[0] for part in (x[:, :half], x[:, half:]))
        c = np.hstack([np.repeat(a, root, 0), np.tile(b, (root, 1))])
    else:
        c = x[rng.integers(len(x))][None, :]
        near = sq_dists(x, c)[:, 0]
        while len(c) < k:
            p = near / near.sum() if near.sum() > 0 else None
            c = np.vstack([c, x[rng.choice(len(x), p=p)]])
            near = np.minimum(near, sq_dists(x, c[-1:])[:, 0])
    for _ in range(rounds):
        codes = sq_dists(x, c).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(codes, minlength=k)
        np.add.at(sums, codes, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    return c, sq_dists(x, c).argmin(1)


def learn(x: np.ndarray, spans: list[tuple[int, int]], k: int, rounds: int = 16, seed: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """TRN03: a codebook for each span of columns, and the codes of the sample."""
    got = [kmeans(x[:, a:b], k, rounds, seed + i) for i, (a, b) in enumerate(spans)]
    return [c for c, _ in got], np.stack([codes for _, codes in got], 1)


def encode(x: np.ndarray, books: list[np.ndarray], spans: list[tuple[int, int]], rounded: bool = False) -> np.ndarray:
    """VQ01: the nearest centroid in each span, the first one on ties. ``rounded`` compares distances rounded to integers (VQ02)."""
    out = np.empty((len(x), len(books)), np.int64)
    for i, ((a, b), c) in enumerate(zip(spans, books, strict=True)):
        if rounded:
            dist = np.rint(((x[:, None, a:b] - c[None]) ** 2).sum(2))
        else:
            dist = (c * c).sum(1)[None, :] - 2 * x[:, a:b] @ c.T
        out[:, i] = dist.argmin(1)
    return out


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.hstack([c[codes[:, i]] for i, c in enumerate(books)])


def update(x: np.ndarray, codes: np.ndarray, spans: list[tuple[int, int]], k: int) -> list[np.ndarray]:
    """TRN04 on a sample: the mean of every code; an empty one is zero."""
    out = []
    for i, (a, b) in enumerate(spans):
        sums, n = np.zeros((k, b - a)), np.bincount(codes[:, i], minlength=k)
        np.add.at(sums, codes[:, i], x[:, a:b])
        out.append(sums / np.maximum(1, n)[:, None])
    return out


def first_rotation(x: np.ndarray, n: int, init: str, seed: int = 0) -> np.ndarray:
    """TRN06: identity, random, gauss (eigenvectors dealt to n subspaces so that their variances are alike), gauss_shuffle (the same, the
    subspaces in random order) or gauss_flat (the same, followed by one random rotation inside every subspace)."""
    dim = x.shape[1]
    if init == "identity" or (init.startswith("gauss") and dim % n):
        return np.eye(dim)
    if init == "random":
        return linalg.random_rotation(dim, seed)
    r = linalg.eigenvalue_allocation(np.cov(x.T, bias=True).reshape(dim, dim), n)
    if init == "gauss_shuffle":
        return r.reshape(n, dim // n, dim)[np.random.default_rng(seed).permutation(n)].reshape(dim, dim)
    if init == "gauss_flat":
        return r @ np.kron(np.eye(n), linalg.random_rotation(dim // n, seed))
    if init != "gauss":
        raise ValueError(f"no initial rotation {init}")
    return r


def learn_rotated(
    x: np.ndarray, spans: list[tuple[int, int]], k: int, rounds: int | None = None, block: int | None = None, init: str | None = None, seed: int = 0
) -> tuple[np.ndarray, list[np.ndarray]]:
    """TRN05, TRN08: a rotation learned with its codebooks: rotate, encode, update, refit the rotation by singular vectors.

    ``block`` limits the rotation to diagonal blocks of so many columns, from the identity in 20 rounds; without it, from gauss in 10.
    """
    dim = x.shape[1]
    rounds = (20 if block else 10) if rounds is None else rounds
    r = first_rotation(x, len(spans), init or ("identity" if block else "gauss"), seed)
    books, codes = learn(x @ r.T, spans, k, 4, seed)
    for _ in range(rounds):
        decoded = decode(codes, books)
        if block:
            r = np.zeros((dim, dim))
            for a in range(0, dim, block):
                b = min(dim, a + block)
                r[a:b, a:b] = linalg.procrustes(decoded[:, a:b].T @ x[:, a:b])
        else:
            r = linalg.procrustes(decoded.T @ x)
        turned = x @ r.T
        codes = encode(turned, books, spans)
        books = update(turned, codes, spans, k)
    return r, books


# ---------------------------------------------------------------- distributed steps


def _centers(sums: DataFrame, width: int) -> DataFrame:
    """(r, n, center) of rows of ``width`` sums and a count, from their cells; rows without a count are left out. As many rows as the model has."""
    cells = sums.select(F.floor(F.col("at") / (width + 1)).cast("int").alias("r"), (F.col("at") % (width + 1)).alias("j"), "x")
    rows = cells.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v"))
    n = F.element_at("v", -1)
    return rows.filter(n > 0).select("r", F.round(n).cast("long").alias("n"), F.transform(F.slice("v", 1, width), lambda x: x / n).alias("center"))


def centroid_update(codes: DataFrame, vector: str, codes_col: str, span: int, k: int = 16) -> DataFrame:
    """TRN04: (codebook, code, center): the mean of all rows of each code, for even spans of ``span`` columns. One partial sum a task."""
    rows = codes.filter(F.col(vector).isNotNull() & F.col(codes_col).isNotNull())
    one = rows.select(F.size(codes_col).alias("n")).first()
    n = 0 if one is None else one["n"]

    def sums(c: list[np.ndarray]) -> np.ndarray:
        x, at = c[0], c[1].astype(np.int64)
        out = np.zeros((n, k, span + 1))
        for b in range(n):
            np.add.at(out[b], at[:, b], np.hstack([x[:, b * span : (b + 1) * span], np.ones((len(x), 1))]))
        return out

    got = _centers(partial_sums(rows, [vector, codes_col], sums, (n, k, span + 1)), span)
    return got.select(F.floor(F.col("r") / k).cast("int").alias("codebook"), (F.col("r") % k).alias("code"), "center")


def lloyd_step(df: DataFrame, vector: str, centers: np.ndarray) -> DataFrame:
    """TRN01: (cluster, n, center): one round over all rows from given centres (a bounded model)."""

    def sums(c: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(centers), centers.shape[1] + 1))
        np.add.at(out, sq_dists(c[0], centers).argmin(1), np.hstack([c[0], np.ones((len(c[0]), 1))]))
        return out

    got = _centers(partial_sums(df.filter(F.col(vector).isNotNull()), [vector], sums, (len(centers), centers.shape[1] + 1)), centers.shape[1])
    return got.select(F.col("r").cast("long").alias("cluster"), "n", "center")


def reconstruct(codes: Column, books: list[np.ndarray]) -> Column:
    """TRN14 as a column."""
    return F.flatten(F.array(*(F.array(*(V.literal(c) for c in book))[codes[i].cast("int")] for i, book in enumerate(books))))
