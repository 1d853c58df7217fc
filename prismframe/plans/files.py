"""Queries that write files and read them back: matrices, series, logs, listings, and tables of results (SRC, SNK)."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators.arrow import matrix
from prismframe.plans.base import FLAT, cells, embeddings, query, table
from prismframe.sources import readers, sinks


def folder(spark: SparkSession) -> str:
    """A new place that all executors share; only a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
    return f"{where}/files/{uuid.uuid4().hex}"


def _lines(df: DataFrame) -> str:
    """Writes a column of lines as text."""
    to = folder(df.sparkSession)
    df.toDF("value").write.text(to)
    return to


ROWS = "SELECT vec_id, pos::INT AS pos, round(x, 5) AS x FROM flat"


@query(f"WITH {FLAT} {ROWS}")
def text_matrix(spark, sf):
    """SRC01: a matrix of numbers in lines, the id in front, between comments and blank lines."""
    e = embeddings(spark, sf).select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "  ").alias("v"))
    lines = e.select(F.explode(F.array(F.lit("# a comment"), F.lit(""), F.concat_ws(" ", "vec_id", "v"))))
    rows = readers.read_text_matrix(spark, _lines(lines)).select(F.col("embedding")[0].cast("long").alias("vec_id"), F.slice("embedding", 2, 64).alias("v"))
    return cells(rows, "vec_id", "v", 5)


def _packed(df: DataFrame, write, per_file: int = 100) -> DataFrame:
    """(path, content): files of about so many rows, each row with its id in front."""
    rows = df.select(F.floor(F.col("vec_id") / per_file).alias("file"), F.concat(F.array(F.col("vec_id").cast("float")), "embedding").alias("v"))
    grouped = rows.groupBy("file").agg(F.array_sort(F.collect_list("v")).alias("rows")).select(F.concat(F.lit("part-"), "file").alias("path"), F.flatten("rows").alias("v"))

    def run(batches):
        for b in batches:
            made = [write(np.array(v, np.float32).reshape(-1, 65)) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return grouped.mapInArrow(run, "path string, content binary")


def _npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def _unpacked(rows: DataFrame) -> DataFrame:
    return cells(rows.select(F.col("embedding")[0].cast("long").alias("id"), F.slice("embedding", 2, 64).alias("v")).withColumnRenamed("id", "vec_id"), "vec_id", "v", 5)


@query(f"WITH {FLAT} {ROWS}")
def npy_matrices(spark, sf):
    """SRC01, SRC13: matrices in .npy files, decoded task by task."""
    return _unpacked(readers.decode_npy(_packed(embeddings(spark, sf), _npy)))


@query(f"WITH {FLAT} {ROWS}")
def vecs_matrices(spark, sf):
    """SRC03: rows that begin with their length."""
    write = lambda x: b"".join(np.int32(x.shape[1]).tobytes() + r.tobytes() for r in x)
    return _unpacked(readers.decode_vecs(_packed(embeddings(spark, sf), write), "f"))


@query("""SELECT vec_id, label::INT AS label, round(list_sum(list_transform(embedding[2:], lambda x: x::DOUBLE)), 5) AS total, 2 AS missing FROM embeddings""")
def labelled_series(spark, sf):
    """SRC06: tab-separated series after a label; what is missing is null."""
    v = F.transform(F.slice("embedding", 2, 63), lambda x: x.cast("double").cast("string"))
    lines = embeddings(spark, sf).select(F.array_join(F.concat(F.array(F.concat("label", F.lit(".0"))), F.array(F.col("vec_id").cast("string"), F.lit("NaN"), F.lit("nan")), v), "\t"))
    got = readers.read_series(spark, _lines(lines))
    values = F.slice("series", 4, 63)
    return got.select(F.col("series")[0].cast("long").alias("vec_id"), "label", F.round(V.total(values), 5).alias("total"), F.size(F.filter("series", lambda x: x.isNull())).alias("missing"))


@query(f"""WITH {FLAT}, q AS (SELECT vec_id // 100 AS file, vec_id % 100 AS t, pos, floor(x * 1000 + 0.5) AS x FROM flat WHERE pos < 4),
m AS (SELECT file, t, pos, x - avg(x) OVER (PARTITION BY file, pos) AS x FROM q WHERE t >= 3) SELECT 'part-' || file AS path, (t - 3)::BIGINT AS t, pos::INT AS pos, round(x, 6) AS x FROM m""")
def recordings(spark, sf):
    """SRC10: interleaved 16-bit samples of four channels, the first three left out, channels centred."""
    rows = embeddings(spark, sf).select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("float")).alias("v"))
    grouped = rows.groupBy(F.floor(F.col("vec_id") / 100).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r"))

    def run(batches):
        for b in batches:
            made = [np.array(v, "<i2").tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    files = grouped.select(F.concat(F.lit("part-"), "file").alias("path"), F.flatten(F.transform("r", lambda x: x["v"])).alias("v")).mapInArrow(run, "path string, content binary")
    got = readers.decode_recordings(files, 4, 3)
    return got.select("path", "t", F.posexplode("values").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("SELECT 'event ' || event_id AS key, round(value, 4) AS first, event_id::DOUBLE AS second FROM events WHERE value IS NOT NULL")
def key_value_log(spark, sf):
    """SRC14: lines ``key: value`` of a log, and the numbers in them."""
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    lines = e.select(F.explode(F.array(F.format_string("event %d: took %.4f s in trial %d", "event_id", F.round("value", 4), "event_id"), F.lit("no pair in this line"))))
    got = readers.read_key_values(spark, _lines(lines))
    return got.select("key", F.col("numbers")[0].alias("first"), F.col("numbers")[1].alias("second"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def dirty_csv(spark, sf):
    """SRC15: a CSV among lines of other output."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).cast("decimal(18,2)").alias("o_totalprice"))
    lines = o.select(F.explode(F.array(F.lit("---- run, again"), F.lit("warming up"), F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice"))))
    return readers.read_dirty_csv(spark, _lines(lines), "o_orderkey long, o_orderstatus string, o_totalprice double").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT 'scan ' || p_partkey AS name, p_partkey::BIGINT AS n, p_size::BIGINT AS d, 8 AS m, round(p_partkey / 4, 2) AS first, round(p_partkey / 2, 2) AS last, 3 AS trials FROM part")
def benchmark_log(spark, sf):
    """SRC16: lines of shapes and times of a benchmark."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("s"))
    line = F.format_string("scan %d N, D, M: %d, %d, 8, (3 trials): %.2f (1.5e6/s), 7 (2e6/s), %.2f (9/s),", "k", "k", "s", F.col("k") / 4, F.col("k") / 2)
    got = readers.parse_benchmark(spark.read.text(_lines(p.select(F.explode(F.array(line, F.lit("scan without a shape: 3")))))))
    return got.select("name", "n", "d", F.col("m").cast("int").alias("m"), F.col("times")[0].alias("first"), F.element_at("times", -1).alias("last"), F.size("times").alias("trials"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, 1::BIGINT AS files FROM region")
def files_by_name(spark, sf):
    """SNK03, SRC17: a folder for each parameter, and the files in them by prefix and suffix."""
    to = folder(spark)
    sinks.save_partitioned(table(spark, sf, "region"), to, ["r_regionkey"])
    found = readers.list_files(spark, to, "part-", ".parquet", recursive=True).filter("length > 0")
    return found.groupBy(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("long").alias("r_regionkey")).agg(F.count("*").alias("files"))


@query("""SELECT user_id, arg_max(round(value, 4), (ts, event_id)) AS value, 'second' AS run FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY user_id
UNION ALL SELECT user_id, arg_max(round(value, 4), (ts, event_id)), 'first' FROM events WHERE value IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value IS NOT NULL) GROUP BY user_id""")
def appended_results(spark, sf):
    """SNK01, SNK02, FLT08: a table of results that a second run is appended to; of equal keys the newest stays."""
    to = folder(spark)
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    last = F.max_by(F.round("value", 4), F.struct("ts", "event_id")).alias("value")
    for run, rows in (("first", e), ("second", e.filter("event_type = 'view'"))):
        got = sinks.save_appended(rows.groupBy("user_id").agg(last).withColumn("run", F.lit(run)), to, ["user_id"])
    return got.select("user_id", "value", "run")


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def memoized_result(spark, sf):
    """SNK04: made once; the second call reads what the first has written."""
    to, n = folder(spark), table(spark, sf, "nation")
    sinks.memoized(spark, to, lambda: n.groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.count("*").alias("n")))
    return sinks.memoized(spark, to, lambda: n.select(F.lit(0).alias("made again")))
