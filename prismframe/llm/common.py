"""What several operators share: Arrow text access, row-wise mapping, hashing, labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handled in pieces of about so many bytes, so that the working arrays of a task stay small.
CHUNK_BYTES = 2 << 20
#: Labels whose shares are broadcast; more are joined by a shuffle.
MOST_LABELS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; a null is empty."""
    arr = arr.cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if len(arr) and arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    arr = batch.column(batch.schema.get_field_index(text))
    _, offsets = utf8(arr)
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def map_text(
    df: DataFrame, text: str, keep: list[str], outputs: list[T.StructField], fn: Callable[[pa.Array], list[pa.Array]], most: int = CHUNK_BYTES
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the arrays that ``fn`` makes of each piece of the text column, with no shuffle.

    An input column named like an output gives way to the output.
    """
    names = {f.name for f in outputs}
    keep = [c for c in keep if c not in names]
    by_name = {f.name: f for f in df.schema.fields}
    schema = T.StructType([by_name[c] for c in keep] + outputs)
    source = "__text"
    while source in keep:
        source += "_"
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, source, most):
                made = fn(part.column(part.schema.get_field_index(source)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def id_remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the labelled queries. A null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled_sample(df: DataFrame, label: str, id_col: str, text: str, per_label: int) -> dict:
    """Up to ``per_label`` texts of every label, the same for the same rows: those with the smallest hash of id, text and label.

    Rows equal in all three count once. One pass counts the labels; a second one reads the rows whose hash is below the share that holds
    half as many rows again as are wanted. What is collected grows with the number of labels, as does any model of them.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(label), F.col(text))
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), h.alias("h"), F.col(text).alias("x"))
    counts = rows.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).select("y", F.least(F.lit(1.0), F.lit(1.5 * per_label + 20) / F.greatest(F.lit(1), "n")).alias("share"))
    shares = counts.collect()
    counts = df.sparkSession.createDataFrame(shares, counts.schema)
    counts = F.broadcast(counts) if len(shares) <= MOST_LABELS else counts
    uniform = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(counts, "y").filter(uniform < F.col("share")).groupBy("y", "h").agg(F.first("x").alias("x"))
    got: dict = {}
    for r in sample.toLocalIterator():
        got.setdefault(r["y"], []).append((r["h"], r["x"] or ""))
    # rows are ordered by the same uniform value as the share is cut by
    return {y: [x for _, x in sorted(v, key=lambda p: (p[0] % (1 << 30), p))[:per_label]] for y, v in sorted(got.items())}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        where = sc.getCheckpointDir()
    return where


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    to = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def word_count(c: Column) -> Column:
    """The number of whitespace-separated words; of a null text none."""
    blanks = " \t\n\x0b\f\r"
    plain = F.btrim(F.coalesce(c, F.lit("")), F.lit(blanks))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, f"[{blanks}]+"))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once. An expression that a lambda uses may else be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
