"""Readers of matrices, labelled series, meters, recordings and logs (SRC01-SRC03, SRC06-SRC10, SRC13-SRC17). All distributed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = "vec_id long, embedding array<float>"


def _files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """SRC17: whole files by glob; hidden ones are left out by Spark."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def list_files(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", recursive: bool = False) -> DataFrame:
    """SRC17: (path, name, length), without reading the contents."""
    rows = _files(spark, path, None, recursive).select("path", "length").withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.filter(F.col("name").startswith(prefix) & F.col("name").endswith(suffix)).select("path", "name", "length")


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """Every file's matrix as rows (path, vec_id, embedding), vec_id counting inside the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.atleast_2d(decode(content.as_py()))
                for lo in range(0, len(x), 10_000):
                    part = np.ascontiguousarray(x[lo : lo + 10_000], np.float32)
                    at = np.arange(0, part.size + 1, max(1, part.shape[1]), dtype=np.int32)
                    rows = pa.ListArray.from_arrays(pa.array(at), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(lo, lo + len(part))), rows], names=["path", "vec_id", "embedding"])

    return files.select("path", "content").mapInArrow(run, schema)


def decode_npy(files: DataFrame) -> DataFrame:
    """SRC01, SRC13: (path, vec_id, embedding) of files (path, content)."""
    return _decoded(files, lambda b: np.load(io.BytesIO(b), allow_pickle=False), f"path string, {VECTORS}")


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    return decode_npy(_files(spark, path, glob))


def yael(content: bytes, kind: str) -> np.ndarray:
    """Rows that each begin with their length as a 4-byte integer; all lengths must agree."""
    size = {"f": 4, "i": 4, "b": 1}[kind]
    if not content:
        return np.zeros((0, 0), np.float32)
    dim = int(np.frombuffer(content[:4], "<i4")[0])
    width = 4 + dim * size
    if dim <= 0 or len(content) % width:
        raise ValueError(f"rows of {dim} components don't fill {len(content)} bytes")
    rows = np.frombuffer(content, np.uint8).reshape(-1, width)
    if (rows[:, :4].copy().view("<i4") != dim).any():
        raise ValueError("rows of different lengths")
    return rows[:, 4:].copy().view({"f": "<f4", "i": "<i4", "b": "u1"}[kind]).astype(np.float32)


def decode_vecs(files: DataFrame, kind: str = "f") -> DataFrame:
    """SRC03: (path, vec_id, embedding) of files (path, content)."""
    return _decoded(files, lambda b: yael(b, kind), f"path string, {VECTORS}")


def read_vecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """SRC03: .fvecs, .ivecs or .bvecs."""
    return decode_vecs(_files(spark, path, f"*.{kind}vecs"), kind)


def read_text_matrix(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """SRC01: (embedding), a line a row; blank lines and lines starting with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.transform(F.split("value", sep), lambda x: x.try_cast("double")).alias("embedding"))


def read_series(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """SRC06: (label, series): the label stands first; missing values are null."""
    parts = F.split(F.trim("value"), sep)
    value = lambda x: F.when(F.lower(x) == "nan", F.lit(None)).otherwise(x.try_cast("double"))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.col("p")[0].cast("double").cast("int").alias("label"), F.transform(F.slice("p", 2, F.size("p") - 1), value).alias("series"))


def read_series_stats(spark: SparkSession, path: str) -> DataFrame:
    """SRC08: a CSV of series sets with a header, and the accuracy of the nearest neighbour from its error ``ED (w=0)``."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumn("l2-1nn-acc", 1 - F.col("`ED (w=0)`"))


def fill_missing(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """SRC07: missing components take the median of their position, or of all values if the position has none."""
    flat = df.select(id_col, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    by_pos = flat.groupBy("pos").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    overall = flat.agg(F.percentile("x", F.lit(0.5)).alias("all"))
    medians = by_pos.crossJoin(F.broadcast(overall)).select("pos", F.coalesce("m", "all").alias("m"))
    medians = medians.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("__m"))
    filled = F.zip_with(vector, "__m", lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x.cast("double")))
    return df.crossJoin(F.broadcast(medians)).withColumn(vector, filled).drop("__m")


def reindex_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """SRC07: labels as 0 to C - 1, in order; labels are few."""
    values = df.select(label).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(values, label)


def read_meters(spark: SparkSession, path: str, schema: str, time: str) -> DataFrame:
    """SRC09: a CSV with a header and a time column in seconds; ``ts`` is the time as a timestamp, ``ms`` in milliseconds."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.withColumn("ts", F.timestamp_seconds(time)).withColumn("ms", F.unix_millis("ts"))


def decode_recordings(files: DataFrame, channels: int, skip_rows: int = 0) -> DataFrame:
    """SRC10: (path, t, values) of interleaved little-endian 16-bit samples, the first ``skip_rows`` left out, channels centred."""
    rows = _decoded(files, lambda b: np.frombuffer(b[: len(b) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)[skip_rows:], f"path string, {VECTORS}")
    w = Window.partitionBy("path")
    centred = [V - F.avg(V).over(w) for V in (F.col("embedding")[c].cast("double") for c in range(channels))]
    return rows.select("path", F.col("vec_id").alias("t"), F.array(*centred).alias("values"))


def read_recording(spark: SparkSession, path: str, channels: int, skip_rows: int = 0, glob: str = "*") -> DataFrame:
    return decode_recordings(_files(spark, path, glob), channels, skip_rows)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (key, value, numbers) of lines ``key: value``; all numbers of the value."""
    lines = spark.read.text(path).filter(F.col("value").contains(":"))
    at = F.instr("value", ":")
    rows = lines.select(F.trim(F.substring("value", F.lit(1), at - 1)).alias("key"), F.trim(F.substring("value", at + 1, F.length("value"))).alias("value"))
    numbers = F.regexp_extract_all("value", F.lit(r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return rows.withColumn("numbers", F.transform(numbers, lambda x: x.cast("double")))


def read_dirty_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC15: only lines with a comma that don't start with a dash; lines that don't parse have nulls."""
    lines = spark.read.text(path).filter(F.col("value").contains(",") & ~F.col("value").startswith("-"))
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def parse_benchmark(lines: DataFrame, c: str = "value") -> DataFrame:
    """SRC16: (name, n, d, m, extra, times, rates) of lines ``name N, D, M, ...: n, d, m, ... (trials): time (rate/s), ...``; others are left out."""
    pattern = r"^(.*?)\s+N,\s*D,\s*M[^:]*:\s*(\d+),\s*(\d+),\s*(\d+),?\s*([^(]*?)\s*\([^)]*\):\s*(.*)$"
    rows = lines.filter(F.col(c).rlike(pattern))
    part = lambda i: F.regexp_extract(c, pattern, i)

    def numbers(found: str) -> Column:
        return F.transform(F.regexp_extract_all(part(6), F.lit(found), F.lit(1)), lambda x: x.try_cast("double"))

    shape = [part(i + 2).cast("long").alias(n) for i, n in enumerate("ndm")]
    return rows.select(part(1).alias("name"), *shape, part(5).alias("extra"), numbers(r"([-+.0-9e]+)\s*\(").alias("times"), numbers(r"\(([-+.0-9e]+)/s\)").alias("rates"))


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC11: (path, label, content): the folder is the class, numbered in order. Decoding is left to the caller's image library."""
    rows = _files(spark, path, glob, True).withColumn("class", F.element_at(F.split("path", "/"), -2))
    return reindex_labels(rows, "class", "label").select("path", "class", "label", "content")


#: SRC02: parts of a named retrieval set, and what stands in for a part that is missing.
PARTS = {"train": ("train", "test"), "test": ("test",), "queries": ("queries", "test"), "truth": ("truth",)}


def load_dataset(spark: SparkSession, tables: dict[str, str], num_queries: int = 100, id_col: str = "vec_id", seed: int = 0) -> dict[str, DataFrame | None]:
    """SRC02: the parts of a set from paths of Parquet tables. Without a training part the test rows serve; without queries, sampled test rows."""
    out: dict[str, DataFrame | None] = {}
    for part, sources in PARTS.items():
        found = next((s for s in sources if s in tables), None)
        df = None if found is None else spark.read.parquet(tables[found])
        if df is not None and part == "queries" and found != "queries":
            df = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(num_queries)
        out[part] = df
    return out
