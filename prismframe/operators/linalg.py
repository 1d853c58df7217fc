"""Small dense algebra after distributed sums: Gram matrices, rotations, principal components (TRN05-TRN11, PRE20, WIN05)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismframe.operators.arrow import sum_partials


def column_means(df: DataFrame, vector: str) -> np.ndarray:
    """PRE01: the mean of every position, from one row of sums a task."""
    rows = df.filter(F.col(vector).isNotNull())
    one = rows.select(F.size(vector).alias("n")).first()
    if one is None:
        return np.zeros(0)
    got = sum_partials(rows, [vector], lambda c: np.append(c[0].sum(0), len(c[0])), (one["n"] + 1,))
    return got[:-1] / got[-1]


def gram(df: DataFrame, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, column sums, rows): one augmented product a batch, added up by the executors."""
    got = sum_partials(df.filter(F.col(vector).isNotNull()), [vector], lambda c: (z := np.hstack([c[0], np.ones((len(c[0]), 1))])).T @ z, (dim + 1, dim + 1))
    return got[:dim, :dim], got[:dim, dim], int(round(got[dim, dim]))


def gram_factor(df: DataFrame, vector: str) -> np.ndarray:
    """A square matrix R with R'R = X'X over all rows: norms, products and principal directions of X's columns are those of R's."""
    one = df.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if one is None:
        return np.zeros((0, 0))
    w, v = np.linalg.eigh(gram(df, vector, one["n"])[0])
    return np.sqrt(np.maximum(0, w))[:, None] * v.T


def covariance(df: DataFrame, vector: str, dim: int) -> np.ndarray:
    xx, sums, n = gram(df, vector, dim)
    return xx / n - np.outer(sums / n, sums / n)


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-20))
    return cov / np.outer(sd, sd)


def cross(df: DataFrame, a: str, b: str, da: int, db: int) -> np.ndarray:
    """A'B of two vector columns."""
    return sum_partials(df, [a, b], lambda c: c[0].T @ c[1], (da, db))


def principal(sym: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors, as columns; each one's largest component is positive."""
    w, v = np.linalg.eigh(sym)
    v = v[:, np.argsort(-w, kind="stable")[:k]]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def power_iteration(sym: np.ndarray, rounds: int = 5, start: np.ndarray | None = None) -> np.ndarray:
    v = sym.sum(0) if start is None else start
    for _ in range(rounds):
        v = v / max(1e-30, np.linalg.norm(v))
        v = sym @ v
    return v / max(1e-30, np.linalg.norm(v))


def top_component(sym: np.ndarray, guesses: int = 32, rounds: int = 50, momentum: float = 0.0, seed: int = 0) -> np.ndarray:
    """TRN10: the best of several power iterations, with momentum."""
    rng = np.random.default_rng(seed)
    best, value = None, -np.inf
    for _ in range(guesses):
        v, before = rng.normal(size=len(sym)), np.zeros(len(sym))
        v /= np.linalg.norm(v)
        for _ in range(rounds):
            new = sym @ v - momentum * before
            before, v = v, new / max(1e-30, np.linalg.norm(new))
        if (got := v @ sym @ v) > value:
            best, value = v, got
    return best


def sparse_component(sym: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """TRN11: a leading component with k entries: pursuit by correlation with the residual, refitted by power iterations on its support."""
    lead = principal(sym, 1)[:, 0]
    support: list[int] = []
    residual = lead.copy()
    for _ in range(min(k, len(sym))):
        j = int(np.argmax(np.where(np.isin(np.arange(len(sym)), support), -1, np.abs(sym @ residual))))
        support.append(j)
        sub = sym[np.ix_(support, support)]
        v = power_iteration(sub, rounds, lead[support])
        residual = lead.copy()
        residual[support] -= v * (v @ lead[support])
    out = np.zeros(len(sym))
    out[support] = v
    return out


def random_rotation(dim: int, seed: int = 0) -> np.ndarray:
    """PRE20: orthonormal rows."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def eigenvalue_allocation(cov: np.ndarray, n: int) -> np.ndarray:
    """TRN07: a rotation by eigenvectors, dealt to n subspaces so that the products of their variances are alike."""
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w, kind="stable")
    size = len(w) // n
    logs, taken = np.zeros(n), [[] for _ in range(n)]
    floor = max(1e-12, w.max(initial=0) * 1e-9)
    for j in order[: size * n]:
        open_ = [b for b in range(n) if len(taken[b]) < size]
        b = min(open_, key=lambda b: (logs[b], b))
        taken[b].append(j)
        logs[b] += np.log(max(w[j], floor) / floor)
    return v[:, [j for t in taken for j in t]].T


def threshold_permutation(stat: np.ndarray, size: int, how: str = "top", seed: int = 0) -> list[int]:
    """TRN09: dimensions grouped by the leading eigenvector of what is left of a covariance or correlation matrix.

    ``top`` takes the ``size`` largest components in absolute value, ``sample`` draws in proportion to them.
    """
    rng = np.random.default_rng(seed)
    left, out = list(range(len(stat))), []
    while len(left) > size:
        weight = np.abs(power_iteration(stat[np.ix_(left, left)]))
        if how == "sample":
            p = (weight + 1e-12) / (weight + 1e-12).sum()
            pick = rng.choice(len(left), size, replace=False, p=p)
        else:
            pick = np.argsort(-weight, kind="stable")[:size]
        out += [left[i] for i in sorted(pick.tolist())]
        left = [x for i, x in enumerate(left) if i not in set(pick.tolist())]
    return out + left


def ridge(xx: np.ndarray, xy: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(xx + lam * np.eye(len(xx)), xy)


def procrustes(xhat_x: np.ndarray) -> np.ndarray:
    """TRN05: the rotation R = UV of the singular vectors of decoded' x original."""
    u, _, vt = np.linalg.svd(xhat_x)
    return u @ vt
