"""Classes from few prototypes and linear models (CLS01-CLS05), trained on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismframe.operators.codebook import kmeans, sq_dists


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn_prototypes(x: np.ndarray, y: np.ndarray, per_class: int = 2, gamma: float = 1.0, rounds: int = 100, rate: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """CLS01, CLS03: (prototypes, labels): class centroids moved by the gradient of the log-loss of the soft vote softmax(-gamma d2)."""
    protos, labels = [], []
    for c in np.unique(y):
        got, _ = kmeans(x[y == c], min(per_class, int((y == c).sum())), 8, seed)
        protos.append(got)
        labels += [c] * len(got)
    p, labels = np.vstack(protos), np.array(labels)
    for _ in range(rounds):
        s = softmax(-gamma * sq_dists(x, p))
        own = s * (labels[None, :] == y[:, None])
        t = own / np.maximum(1e-12, own.sum(1, keepdims=True))
        g = s - t  # gradient on -gamma * d2
        grad = -2 * gamma * (g.T @ x - g.sum(0)[:, None] * p) / len(x)
        p = p - rate * grad
    return p, labels


def vote(x: np.ndarray, p: np.ndarray, labels: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    s = softmax(-gamma * sq_dists(x, p))
    classes = np.unique(labels)
    return classes[np.stack([s[:, labels == c].sum(1) for c in classes], 1).argmax(1)]


def learn_projected_prototypes(x: np.ndarray, y: np.ndarray, dims: int, per_class: int = 2, **more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CLS02: (projection, prototypes, labels): prototypes in the leading directions between classes and within."""
    means = np.stack([x[y == c].mean(0) for c in np.unique(y)])
    _, _, vt = np.linalg.svd(np.vstack([np.sqrt(len(x)) * (means - x.mean(0)), x - x.mean(0)]), full_matrices=False)
    w = vt[:dims].T
    return (w, *learn_prototypes(x @ w, y, per_class, **more))


def learn_softmax(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """CLS04, CLS05: (D, classes) weights of a softmax without intercept, by gradient steps on the log-loss."""
    classes = np.unique(y)
    hot = (y[:, None] == classes[None, :]).astype(float)
    w = np.zeros((x.shape[1], len(classes)))
    step = rate / max(1e-12, (x * x).sum(1).mean())
    for _ in range(rounds):
        w -= step * (x.T @ (softmax(x @ w) - hot) / len(x) + ridge * w)
    return w


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, center): over all rows."""
    flat = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return flat.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center"))
