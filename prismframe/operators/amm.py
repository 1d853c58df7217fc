"""Approximate products A @ B of a distributed A with a small B (AMM01-AMM18, AMM20-AMM29, MIT20, UDF02).

Every method is fitted on a bounded sample of A and on B, then applied to A as one narrow projection: (id, product). Random
matrices come from a seed, so any task makes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions import vector as V
from prismframe.operators import encoder, linalg, lutquant, tree
from prismframe.operators.arrow import map_rows, sample


class InvalidParameters(ValueError):
    """The method saves nothing, or can't work, at these sizes."""


class Method:
    """AMM base. ``fit`` sees a sample of A; ``product`` is called with batches."""

    def fit(self, a: np.ndarray, b: np.ndarray) -> Method:
        self.b = b
        return self

    def product(self, a: np.ndarray) -> np.ndarray:
        return a @ self.b

    def cost(self, n: int) -> dict[str, int]:
        """AMM29: multiplications for n rows, encoding included, and table lookups."""
        d, m = self.b.shape
        return {"muls": n * d * m, "lookups": 0}

    def apply(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        return map_rows(df, vector, [id_col], [("product", T.ArrayType(T.DoubleType()), pa.float64())], lambda x: [self.product(x)])


Exact = Method


def scalar_quantize(x: np.ndarray, axis: int, signed: bool = False, nbits: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PRE09: (offsets, scales, integers) for each row (axis 0) or column (axis 1)."""
    low, high = x.min(1 - axis, keepdims=True), x.max(1 - axis, keepdims=True)
    gap = np.where(high > low, high - low, 1.0)
    scale = (2**nbits - 1) / gap
    shift = 2 ** (nbits - 1) if signed else 0
    q = np.clip(np.floor((x - low) * scale), 0, 2**nbits - 1) - shift
    return low + shift / scale, scale, q


class ScalarQuantize(Method):
    """AMM02: 8-bit rows and columns, with the offsets' part computed exactly."""

    def fit(self, a, b):
        super().fit(a, b)
        self.off, self.scale, self.q = scalar_quantize(b, 1, signed=True)
        return self

    def product(self, a):
        off, scale, q = scalar_quantize(a, 0)
        ones_a, ones_b = q.sum(1, keepdims=True) / scale, self.q.sum(0, keepdims=True) / self.scale
        return q @ self.q / (scale * self.scale) + off * ones_b + ones_a * self.off + off * self.off * a.shape[1]


class Sketch(Method):
    """AMM03: A and B reduced to d columns by one matrix; the product of the reductions.

    The matrix depends on A by norms and products of its columns only, so it may be fitted on ``linalg.gram_factor`` of all rows in place of A.
    """

    def __init__(self, d: int, seed: int = 0):
        self.d, self.seed = d, seed

    def guard(self, dim: int, m: int) -> None:
        if self.d >= dim or (m <= self.d and type(self).strict):
            raise InvalidParameters(f"{self.d} columns save nothing for {dim} x {m}")

    strict = False

    def matrix(self, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def fit(self, a, b):
        super().fit(a, b)
        self.guard(*b.shape)
        self.v = self.matrix(a, b, np.random.default_rng(self.seed))
        self.vb = self.v.T @ b
        return self

    def product(self, a):
        return (a @ self.v) @ self.vb

    def cost(self, n):
        dim, m = self.b.shape
        return {"muls": n * self.v.shape[1] * (dim + m), "lookups": 0}


class RandGauss(Sketch):
    """AMM04."""

    def matrix(self, a, b, rng):
        v = rng.normal(size=(len(b), self.d))
        return v / np.linalg.norm(v, axis=0) * np.sqrt(len(b) / self.d)


class OrthoGauss(Sketch):
    """AMM05."""

    def matrix(self, a, b, rng):
        return np.linalg.qr(rng.normal(size=(len(b), self.d)))[0] * np.sqrt(len(b) / self.d)


class Rademacher(Sketch):
    """AMM06."""

    def matrix(self, a, b, rng):
        return rng.choice([-1.0, 1.0], (len(b), self.d)) / np.sqrt(self.d)


class Hadamard(Sketch):
    """AMM07: the first columns; nothing is random."""

    def matrix(self, a, b, rng):
        return np.array(V.hadamard(len(b), self.d)) / np.sqrt(self.d)


class FastJL(Sketch):
    """AMM13: random signs, a Hadamard transform, a sparse Gaussian."""

    keep = 0.5

    def matrix(self, a, b, rng):
        n = 1 << (len(b) - 1).bit_length()
        h = np.array(V.hadamard(n, n), float)[: len(b)] / np.sqrt(n)
        p = rng.normal(size=(n, self.d)) * (rng.random((n, self.d)) < self.keep) / np.sqrt(self.keep * self.d)
        return rng.choice([-1.0, 1.0], len(b))[:, None] * (h @ p)


class HashJL(Sketch):
    """AMM14: every dimension goes to one column, with a sign."""

    def matrix(self, a, b, rng):
        v = np.zeros((len(b), self.d))
        v[np.arange(len(b)), rng.integers(0, self.d, len(b))] = rng.choice([-1.0, 1.0], len(b))
        return v


class Osnap(Sketch):
    """AMM15: s hash sketches on disjoint ranges of columns."""

    s = 4

    def matrix(self, a, b, rng):
        v = np.zeros((len(b), self.d))
        s = min(self.s, self.d)
        edges = [self.d * i // s for i in range(s + 1)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            v[np.arange(len(b)), rng.integers(lo, hi, len(b))] = rng.choice([-1.0, 1.0], len(b)) / np.sqrt(s)
        return v


class SquareSample(Sketch):
    """AMM08: dimensions drawn in proportion to the product of norms, weighted to be unbiased."""

    def matrix(self, a, b, rng):
        p = np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=1)
        p = p / p.sum() if p.sum() > 0 else np.full(len(b), 1 / len(b))
        v = np.zeros((len(b), self.d))
        picked = rng.choice(len(b), self.d, p=p)
        v[picked, np.arange(self.d)] = 1 / np.sqrt(self.d * p[picked])
        return v


class TopSquare(Sketch):
    """AMM09: the dimensions of the largest products of norms."""

    def matrix(self, a, b, rng):
        p = np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=1)
        v = np.zeros((len(b), self.d))
        v[np.argsort(-p, kind="stable")[: self.d], np.arange(self.d)] = 1
        return v


class Pca(Sketch):
    """AMM17: the leading principal directions of A."""

    def matrix(self, a, b, rng):
        return linalg.principal(a.T @ a / len(a), self.d)


class SparsePca(Sketch):
    """AMM18: directions with few entries each, from deflated soft-thresholded power iterations."""

    alpha = 0.1

    def matrix(self, a, b, rng):
        left, out = a.T @ a / len(a), []
        for _ in range(self.d):
            v = linalg.power_iteration(left, 30, linalg.principal(left, 1)[:, 0])
            v = np.sign(v) * np.maximum(0, np.abs(v) - self.alpha * np.abs(v).max())
            v /= max(1e-12, np.linalg.norm(v))
            out.append(v)
            left = left - np.outer(v, v) * (v @ left @ v)
        v = np.stack(out, 1)
        if np.count_nonzero(v) + self.d * b.shape[1] >= b.size:
            raise InvalidParameters("as many entries as the exact product has")
        return v

    def product(self, a):
        # the directions aren't orthogonal: the projection goes through the inverse of their products
        return (a @ self.v) @ (np.linalg.pinv(self.v) @ self.b)


class Svd(Sketch):
    """AMM16: A and B both cut to rank d, multiplied in the cheapest order."""

    def matrix(self, a, b, rng):
        u, s, vt = np.linalg.svd(b, full_matrices=False)
        self.bu, self.bv = u[:, : self.d] * s[: self.d], vt[: self.d]
        return linalg.principal(a.T @ a / len(a), self.d)

    def product(self, a):
        return ((a @ self.v) @ (self.v.T @ self.bu)) @ self.bv


def frequent_directions(x: np.ndarray, d: int) -> np.ndarray:
    """AMM10: d rows H with H'H near X'X; rows come in one by one in blocks of d. Sketches of parts are merged by sketching them together."""
    h = np.zeros((2 * d, x.shape[1]))
    for lo in range(0, len(x), d):
        part = x[lo : lo + d]
        h[d : d + len(part)] = part
        h[d + len(part) :] = 0
        _, s, vt = np.linalg.svd(h, full_matrices=False)
        kept = np.sqrt(np.maximum(0, s**2 - (s[d] if len(s) > d else 0.0) ** 2))[:d]
        h[:d] = 0
        h[: min(d, len(vt))] = (kept[:, None] * vt[:d])[: min(d, len(vt))]
    return h[:d]


class FrequentDirections(Sketch):
    """AMM10, AMM11: directions that a sketch over the shared dimension keeps."""

    def matrix(self, a, b, rng):
        return np.linalg.svd(frequent_directions(a, self.d), full_matrices=False)[2][: self.d].T


class Cooccurrence(Sketch):
    """AMM12: columns of A' and rows of B absorbed together; the joint spectrum is shrunk as buffers fill."""

    def matrix(self, a, b, rng):
        d = self.d
        bx, by, at = np.zeros((len(a), d)), np.zeros((b.shape[1], d)), 0
        for j in range(len(b)):
            if at == d:
                qx, rx = np.linalg.qr(bx)
                qy, ry = np.linalg.qr(by)
                u, s, vt = np.linalg.svd(rx @ ry.T)
                s = np.sqrt(np.maximum(0, s - s[min(len(s) - 1, d // 2)]))
                w = min(d, len(s), qx.shape[1], qy.shape[1])
                bx, by = np.zeros_like(bx), np.zeros_like(by)
                bx[:, :w], by[:, :w] = (qx @ u[:, : len(s)] * s)[:, :w], (qy @ vt.T[:, : len(s)] * s)[:, :w]
                at = d // 2
            bx[:, at], by[:, at] = a[:, j], b[j]
            at += 1
        # as a projection, so that rows outside the sample have a product too
        return linalg.principal((got := np.linalg.pinv(a) @ bx) @ got.T, d)


class Encoded(Method):
    """AMM20-AMM28: A as codes, B's columns as queries whose tables are made once."""

    def __init__(self, **spec):
        self.spec = replace(encoder.Spec(reduction="dot", quantize="none"), **spec)

    def fit(self, a, b):
        super().fit(a, b)
        self.model = encoder.fit_sample(a, self.spec, b.T)
        luts = self.model.luts_of(b.T)
        self.flat = luts.reshape(len(luts), -1).T.astype(float)
        return self

    def product(self, a):
        codes = self.model.codes_of(a) + np.arange(self.spec.n_codebooks) * self.spec.k
        total = np.zeros((len(a), self.flat.shape[1]))
        for c in range(codes.shape[1]):
            total += self.flat[codes[:, c]]
        return total if self.spec.quantize == "none" else total / self.model.scale + self.model.offsets.sum()

    def cost(self, n):
        d, m = self.b.shape
        c, k = self.spec.n_codebooks, self.spec.k
        turn = n * d * d if self.spec.preproc == "rotate" else n * d * self.spec.block if self.spec.preproc == "rotate_blocks" else 0
        return {"muls": (n * d * k if self.spec.encode == "kmeans" else 0) + turn + m * d * k, "lookups": n * m * c}


class TreeProduct(Method):
    """AMM28, MIT13, MIT17-MIT20: hash trees, centroids refitted by ridge, tables with one power-of-two scale."""

    def __init__(self, n_codebooks: int = 16, work: float = -1, quantize: bool = True, accumulate: str = "sum"):
        self.n, self.work, self.quantize, self.accumulate = n_codebooks, work, quantize, accumulate

    def fit(self, a, b):
        super().fit(a, b)
        self.model = tree.TreeModel.learn(a, self.n, V.even_spans(a.shape[1], self.n), self.work)
        luts = self.model.luts(b.T)
        self.offsets, self.scale = lutquant.power_of_two(luts)
        self.table = lutquant.quantize_half(luts, self.offsets, self.scale) if self.quantize else luts
        return self

    def product(self, a):
        got = np.stack([self.table[:, c, tree.tree_codes(a, t)].T for c, t in enumerate(self.model.trees)], 2)
        if not self.quantize:
            return got.sum(2)
        return (mean_sum(got) if self.accumulate == "mean" else got.sum(2)) / self.scale + self.offsets.sum()

    def cost(self, n):
        d, m = self.b.shape
        per = d if self.work < 0 else max(1, int(self.work * d / self.n))
        return {"muls": m * 16 * self.n * per, "lookups": n * m * self.n}


def mean_sum(x: np.ndarray, every: int = 16) -> np.ndarray:
    """VQ17, MIT18 over the last axis: groups averaged pairwise, rounding up, summed, scaled back, the bias taken off."""
    n = x.shape[-1]
    every = min(n, every)
    total = 0
    for i in range(0, n, every):
        part = x[..., i : i + every]
        while part.shape[-1] > 1:
            part = (part[..., ::2] + part[..., 1::2] + 1) // 2
        total = total + part[..., 0]
    return total * every - int(n / 4 * np.log2(every))


#: UDF02: names to makers; d is the number of columns of a sketch or of codebooks.
REGISTRY: dict[str, Callable[[int], Method]] = {
    "exact": lambda d: Exact(), "scalar_quantize": lambda d: ScalarQuantize(),
    "rand_gauss": RandGauss, "ortho_gauss": OrthoGauss, "rademacher": Rademacher, "hadamard": Hadamard, "fast_jl": FastJL, "hash_jl": HashJL, "osnap": Osnap,
    "square_sample": SquareSample, "top_square": TopSquare, "pca": Pca, "sparse_pca": SparsePca, "svd": Svd, "fd": FrequentDirections, "cooccurrence": Cooccurrence,
    "pq": lambda d: Encoded(n_codebooks=d, k=256), "rotated_pq": lambda d: Encoded(n_codebooks=d, k=256, preproc="rotate"),
    "pq_perm": lambda d: Encoded(n_codebooks=d, k=256, preproc="perm"), "pq_trees": lambda d: Encoded(n_codebooks=d, k=16, encode="tree"),
    "pq_perm_trees": lambda d: Encoded(n_codebooks=d, k=16, encode="tree", preproc="perm"),
    "vq4": lambda d: Encoded(n_codebooks=d, quantize="floor"), "vq4_cov": lambda d: Encoded(n_codebooks=d, quantize="floor", preproc="perm"),
    "vq4_cov_sample": lambda d: Encoded(n_codebooks=d, quantize="floor", preproc="perm_sample"), "vq4_corr": lambda d: Encoded(n_codebooks=d, quantize="floor", preproc="corr"),
    "vq4_corr_sample": lambda d: Encoded(n_codebooks=d, quantize="floor", preproc="corr_sample"), "vq4_splits": lambda d: Encoded(n_codebooks=d, quantize="floor", encode="splits"),
    "vq4_trees": lambda d: Encoded(n_codebooks=d, quantize="floor", encode="tree"), "vq4_perm_trees": lambda d: Encoded(n_codebooks=d, quantize="floor", encode="tree", preproc="perm"),
    "tree": lambda d: TreeProduct(d), "tree_mean": lambda d: TreeProduct(d, accumulate="mean"), "tree_pq": lambda d: TreeProduct(d, work=1), "tree_sparse": lambda d: TreeProduct(d, work=2),
    "tree_float": lambda d: TreeProduct(d, quantize=False),
}


def fitted(df: DataFrame, b: np.ndarray, method: str, d: int = 16, id_col: str = "vec_id", vector: str = "embedding", most: int = 4000) -> Method:
    """A registered method: sketches by the column products of all rows, codes and trees by a bounded sample."""
    made = REGISTRY[method](d)
    return made.fit(linalg.gram_factor(df, vector) if isinstance(made, Sketch) else sample(df, vector, most, id_col), b)


def multiply(df: DataFrame, b: np.ndarray, method: str, d: int = 16, id_col: str = "vec_id", vector: str = "embedding", most: int = 4000) -> DataFrame:
    """(id, product) by a registered method."""
    return fitted(df, b, method, d, id_col, vector, most).apply(df, id_col, vector)


def metrics(products: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """MET01, DST09: one row over all cells of two products."""
    both = products.select(id_col, F.posexplode("product").alias("m", "yh")).join(exact.select(id_col, F.posexplode("product").alias("m", "y")), [id_col, "m"])
    mse, var = F.avg(F.pow(F.col("y") - F.col("yh"), F.lit(2.0))), F.var_pop("y")
    return both.agg(
        mse.alias("raw_mse"), (mse / var).alias("normalized_mse"), F.corr("y", "yh").alias("corr"),
        (F.sum(F.col("y") * F.col("yh")) / F.sqrt(F.sum(F.col("y") * F.col("y")) * F.sum(F.col("yh") * F.col("yh")))).alias("cossim"),
        F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"), F.avg("yh").alias("yhat_mean"), F.stddev_pop("yh").alias("yhat_std"),
    )


def multiply_coordinates(a: DataFrame, b: DataFrame) -> DataFrame:
    """AMM01 for two distributed matrices in coordinates (i, j, x) and (j, k, y): (i, k, z). Partial sums run before the last shuffle."""
    return a.join(b, "j").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("z"))
