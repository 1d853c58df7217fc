"""Arrow batches as matrices, for the dense linear algebra that column expressions can't carry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix(arr: pa.Array) -> np.ndarray:
    """A list column of equal lengths, without nulls, as rows of doubles."""
    if not len(arr):
        return np.zeros((0, 0))
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m) if m else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def map_rows(df: DataFrame, vector: str, keep: list[str], outputs: list[tuple[str, T.DataType, pa.DataType]], fn: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """``keep`` and what ``fn`` makes of each batch's vectors: matrices become lists, vectors scalars. No shuffle."""
    by_name = {f.name: f for f in df.schema.fields}
    schema = T.StructType([by_name[c] for c in keep] + [T.StructField(n, k) for n, k, _ in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = fn(matrix(b.column(len(keep))))
                made = [lists(x, kind) if x.ndim == 2 else pa.array(x, kind) for x, (_, _, kind) in zip(made, outputs, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names=schema.names)

    return df.select(*keep, F.col(vector).alias("__v")).filter("__v IS NOT NULL").mapInArrow(run, schema)


def partial_sums(df: DataFrame, columns: list[str], fn: Callable[[list[np.ndarray]], np.ndarray], shape: tuple[int, ...]) -> DataFrame:
    """(at, x): the cells of the sum over all batches of a matrix of fixed shape that ``fn`` makes of a batch's columns: one partial sum a task."""
    cells = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                out += fn([matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(out.ravel())], names=["at", "x"])

    return df.select(*columns).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))


def sum_partials(df: DataFrame, columns: list[str], fn: Callable[[list[np.ndarray]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """``partial_sums`` added up by executors, as one matrix on the driver."""
    out = np.zeros(int(np.prod(shape)))
    for r in partial_sums(df, columns, fn, shape).collect():
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def sample(df: DataFrame, vector: str, most: int, id_col: str, seed: int = 0) -> np.ndarray:
    """At most ``most`` vectors, chosen by a hash of their id, in its order."""
    n = df.count()
    share = min(1.0, (1.2 * most + 50) / max(1, n))
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = df.filter(F.col(vector).isNotNull() & (uniform <= share)).select(uniform.alias("u"), F.col(id_col).alias("i"), F.col(vector).alias("v")).limit(2 * most + 100).collect()
    rows = sorted(rows, key=lambda r: (r["u"], r["i"]))[:most]
    return np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def sample_by_label(df: DataFrame, vector: str, label: str, per_label: int, id_col: str, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At most ``per_label`` vectors of every label, chosen by a hash of their id, and their labels, in the order of the ids."""
    known = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for r in known.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect():
        share = F.when(F.col(label) == F.lit(r["y"]), F.lit(min(1.0, (1.2 * per_label + 50) / r["n"]))).otherwise(share)
    by_label: dict = {}
    for r in known.filter(uniform <= share).select(uniform.alias("u"), F.col(id_col).alias("i"), F.col(label).alias("y"), F.col(vector).alias("v")).toLocalIterator():
        by_label.setdefault(r["y"], []).append((r["u"], r["i"], r["v"]))
    rows = sorted((i, y, v) for y, own in by_label.items() for _, i, v in sorted(own)[:per_label])
    return np.array([v for _, _, v in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0)), np.array([y for _, y, _ in rows])
