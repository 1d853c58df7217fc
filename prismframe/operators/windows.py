"""Sliding windows over arrays, rows and images, lagged designs, resampling (WIN01-WIN08, PRE17, PRE18, SRC09)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators import linalg


def array_windows(v: Column, width: int, step: int = 1) -> Column:
    """WIN01: ARRAY of all whole windows of a vector; none if it is shorter."""
    starts = F.when(F.size(v) >= width, F.sequence(F.lit(1), F.size(v) - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(v, i, width))


def stacked_windows(df: DataFrame, id_col: str, vector: str, width: int, step: int = 1) -> DataFrame:
    """WIN02: (id, at, window), a row a window."""
    return df.select(id_col, F.posexplode(array_windows(F.col(vector), width, step)).alias("at", "window"))


def row_windows(df: DataFrame, series: str, order: list[str], value: str, width: int) -> DataFrame:
    """WIN01 over rows: (all columns, window) of the rows with width - 1 rows after them in their series."""
    w = Window.partitionBy(series).orderBy(*order).rowsBetween(0, width - 1)
    return df.withColumn("window", F.collect_list(value).over(w)).filter(F.size("window") == width)


def first_difference(df: DataFrame, series: str, order: list[str], value: str, out: str = "diff") -> DataFrame:
    """PRE17: null on a series' first row."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(series).orderBy(*order)))


def back_fill(df: DataFrame, series: str, order: list[str], value: str, out: str) -> DataFrame:
    """SRC09: the next value that is there, at or after a row, in its series."""
    w = Window.partitionBy(series).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def lag_matrix(df: DataFrame, series: str, order: list[str], value: str, width: int) -> DataFrame:
    """WIN04: ``x`` = the width values before a row, oldest first, ``y`` = its own; rows with a whole history."""
    w = Window.partitionBy(series).orderBy(*order)
    out = df.withColumn("x", F.array(*(F.lag(value, width - i).over(w) for i in range(width)))).withColumn("y", F.col(value))
    return out.filter(F.forall("x", lambda e: e.isNotNull()) & F.col("y").isNotNull())


def fit_autoregression(design: DataFrame, width: int, strength: float = 0.1) -> dict:
    """WIN05: ridge coefficients and r2 of a lagged design; the penalty is a share of the values' variance. Only sums leave the executors."""
    aug = design.select(F.concat("x", F.array("y")).alias("z"))
    xx, s, n = linalg.gram(aug, "z", width + 1)
    if not n:
        return {"weights": [0.0] * width, "intercept": 0.0, "r2": None, "n": 0}
    mean = s / n
    cov = xx / n - np.outer(mean, mean)
    lam = strength * float(np.trace(cov[:width, :width]) / width)
    w = linalg.ridge(cov[:width, :width], cov[:width, width], lam / n)
    left = cov[width, width] - 2 * w @ cov[:width, width] + w @ cov[:width, :width] @ w
    return {"weights": w.tolist(), "intercept": float(mean[width] - w @ mean[:width]), "r2": float(1 - left / cov[width, width]) if cov[width, width] > 0 else None, "n": n}


def resample(x: np.ndarray, length: int) -> np.ndarray:
    """PRE18: rows resampled by their Fourier series."""
    n = x.shape[1]
    f = np.fft.rfft(x, axis=1)
    half = min(n, length) // 2 + 1
    out = np.zeros((len(x), length // 2 + 1), complex)
    out[:, :half] = f[:, :half]
    if min(n, length) % 2 == 0 and n != length:
        out[:, min(n, length) // 2] *= 0.5 if length > n else 2.0
        if length < n:
            out[:, length // 2] = out[:, length // 2].real
    return np.fft.irfft(out, length, axis=1) * (length / n)


# ---------------------------------------------------------------- images: flat arrays, row after row, channels last


def patches(image: Column, height: int, width: int, channels: int, size: tuple[int, int], stride: tuple[int, int] = (1, 1), same: bool = False) -> Column:
    """WIN03: ARRAY of flat patches. ``same`` pads with zeros so that each stride has a patch; else only whole ones."""
    (ph, pw), (sh, sw) = size, stride
    top, left = ((ph - 1) // 2, (pw - 1) // 2) if same else (0, 0)
    ys = range(0, height if same else height - ph + 1, sh)
    xs = range(0, width if same else width - pw + 1, sw)
    places = [
        [
            (y + i - top) * width * channels + (x + j - left) * channels + c if 0 <= y + i - top < height and 0 <= x + j - left < width else -1
            for i in range(ph) for j in range(pw) for c in range(channels)
        ]
        for y in ys for x in xs
    ]
    index = F.array(*(F.array(*map(F.lit, p)) for p in places))
    return F.transform(index, lambda p: F.transform(p, lambda i: F.when(i < 0, F.lit(0.0)).otherwise(V.d(F.get(image, i)))))


def gaussian(size: int, sigma: float | None = None) -> list[list[float]]:
    sigma = sigma or size / 5
    one = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    total = sum(one) ** 2
    return [[a * b / total for b in one] for a in one]


def sobel(size: int = 3) -> list[list[list[float]]]:
    """Horizontal and vertical derivative: a difference along one axis, smoothed by binomials along the other; antisymmetric for size 5 too."""
    smooth = [float(math.comb(size - 1, i)) for i in range(size)]
    low = [float(math.comb(size - 3, i)) for i in range(size - 2)]
    slope = [(low[i] if i < len(low) else 0.0) - (low[i - 2] if i >= 2 else 0.0) for i in range(size)]
    gx = [[s * d for d in slope] for s in smooth]
    return [gx, [list(r) for r in zip(*gx, strict=True)]]


def filter_bank(name: str, size: int = 3) -> list[list[float]]:
    """WIN07: flat kernels: sobel, gaussian, dog (a difference of Gaussians), sharpen or identity."""
    flat = lambda k: [x for r in k for x in r]
    middle = [[float(i == j == size // 2) for j in range(size)] for i in range(size)]
    if name == "sobel":
        return [flat(k) for k in sobel(size)]
    if name == "gaussian":
        return [flat(gaussian(size))]
    if name == "dog":
        return [[a - b for a, b in zip(flat(gaussian(size, size / 8)), flat(gaussian(size, size / 4)), strict=True)]]
    if name == "sharpen":
        return [[2 * a - b for a, b in zip(flat(middle), flat(gaussian(size)), strict=True)]]
    return [flat(middle)]


def convolve(df: DataFrame, id_col: str, image: str, height: int, width: int, kernels: list[list[float]], size: int, same: bool = False) -> DataFrame:
    """WIN06, WIN08: (id, at, patch, out): each patch and its products with the kernels."""
    rows = df.select(id_col, F.posexplode(patches(F.col(image), height, width, len(kernels[0]) // (size * size), (size, size), same=same)).alias("at", "patch"))
    return rows.withColumn("out", F.array(*(V.dot(F.col("patch"), V.literal(k)) for k in kernels)))


def evenly_spaced_quantiles(df: DataFrame, by: str, x: str, n: int) -> DataFrame:
    """PRE21: (by, quantiles): n cuts of each group's distinct values. n distinct values are the cuts themselves; of fewer than 2n, even steps
    from the least to the largest; of a single one, steps from its negative to three times it."""
    distinct = df.filter(F.col(x).isNotNull()).select(by, F.col(x).cast("double").alias("x")).distinct()
    at = lambda shares: F.percentile("x", F.array(*map(F.lit, shares)))
    got = distinct.groupBy(by).agg(F.count("*").alias("m"), F.min("x").alias("a"), F.max("x").alias("b"), at([i / (n + 1) for i in range(1, n + 1)]).alias("q"), at([i / max(1, n - 1) for i in range(n)]).alias("own"))
    steps = lambda a, b: F.array(*(a + (b - a) * (i / max(1, n - 1)) for i in range(n)))
    small = F.when(F.col("m") == n, F.col("own")).when(F.col("m") == 1, steps(-F.col("a"), F.col("a") * 3)).when(F.col("m") < 2 * n, steps(F.col("a"), F.col("b")))
    return got.select(by, F.coalesce(small, F.col("q")).alias("quantiles"))
