"""Queries of small parts: bits, quantiles, filters, grids, derived figures (PRE, FLT, GRD, MET, KNN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators import encoder, knn, sampling, tree, windows
from prismframe.plans.base import CENTROIDS, CODEBOOKS, FLAT, asked, books, embeddings, query, table
from prismframe.plans.files import folder
from prismframe.sources import readers


@query(f"""WITH {FLAT}, v AS (SELECT vec_id, pos, floor((x + 1) * 16)::INT & 31 AS v FROM flat WHERE pos < 6), b AS (SELECT vec_id, pos * 5 + b AS i, (v >> b::INT) & 1 AS bit FROM v, range(5) t(b))
SELECT vec_id, (i // 8)::INT AS at, sum(bit << (7 - i % 8)::INT)::INT AS byte FROM b GROUP BY vec_id, i // 8""")
def pack_bits(spark, sf):
    """PRE13: six values of five bits in four bytes."""
    v = F.transform(F.slice("embedding", 1, 6), lambda x: F.floor((x.cast("double") + 1) * 16))
    return embeddings(spark, sf).select("vec_id", F.posexplode(V.pack_bits(v, 5)).alias("at", "byte"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS k, CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE l_quantity END::DOUBLE AS x FROM lineitem),
g AS (SELECT k, count(*) AS m, min(x) AS a, max(x) AS b, quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q, list(x ORDER BY x) AS own FROM d GROUP BY k),
c AS (SELECT k, CASE WHEN m = 7 THEN own WHEN m = 1 THEN list_transform(range(7), lambda i: -a + 4 * a * i / 6) WHEN m < 14 THEN list_transform(range(7), lambda i: a + (b - a) * i / 6) ELSE q END AS q FROM g)
SELECT k, i::INT AS at, round(q[i + 1], 6) AS cut FROM c, range(7) t(i)""")
def even_quantiles(spark, sf):
    """PRE21: seven cuts of a supplier's quantities, or of its line numbers, which are few."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber").cast("double")).otherwise(F.col("l_quantity").cast("double")).alias("x"))
    return windows.evenly_spaced_quantiles(rows, "k", "x", 7).select("k", F.posexplode("quantiles").alias("at", "cut")).withColumn("cut", F.round("cut", 6))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 AND embedding[4] < 0.02")
def rows_below_a_cut(spark, sf):
    """FLT04, FLT06: every seventh vector is made zero and left out; of the others those on the lower side of a cut."""
    e = embeddings(spark, sf).withColumn("v", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, F.lit(0.0)).otherwise(x.cast("double"))))
    return tree.below(e.filter(V.non_zero(F.col("v"))), "v", 3, 0.02).select("vec_id", "label")


@query("SELECT method, ncodebooks::INT AS ncodebooks, CASE WHEN method <> 'exact' THEN lut_work END::DOUBLE AS lut_work FROM (VALUES ('tree'), ('exact')) m(method), (VALUES (8), (16)) c(ncodebooks), (VALUES (-1.0), (2.0)) l(lut_work) GROUP BY ALL")
def parameter_grid(spark, sf):
    """GRD01: all combinations; one key counts for one method only."""
    rows = sampling.grid({"method": ["tree", "exact"], "ncodebooks": [8, 16], "lut_work": [-1.0, 2.0]}, {"lut_work": {"method": "tree"}})
    return spark.createDataFrame([(r["method"], r["ncodebooks"], r.get("lut_work")) for r in rows], "method string, ncodebooks int, lut_work double")


@query("SELECT p_partkey, round(1 - p_size / 100.0, 4) AS acc FROM part")
def series_stats(spark, sf):
    """SRC08: figures of series sets from a CSV, with the accuracy that follows from an error."""
    to = folder(spark)
    table(spark, sf, "part").select("p_partkey", F.format_number(F.col("p_size") / 100, 4).alias("ED (w=0)")).write.csv(to, header=True)
    return readers.read_series_stats(spark, to).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.round(F.col("`l2-1nn-acc`").cast("double"), 4).alias("acc"))


@query("SELECT 8.0::DOUBLE AS bytes_a_row, 8 * count(*) AS bytes, round(8 / 256.0::DOUBLE, 6) AS share FROM embeddings")
def space_used(spark, sf):
    """MET11: bytes of all codes, and as a share of 64 floats."""
    e = embeddings(spark, sf)
    m = encoder.fixed(books(e), encoder.Spec(n_codebooks=CODEBOOKS, k=CENTROIDS, quantize="none"))
    n = F.count("*")
    return m.encode(e).agg(F.lit(float(m.nbytes)).alias("bytes_a_row"), (n * int(m.nbytes)).alias("bytes"), F.round(F.lit(m.nbytes / 256), 6).alias("share"))


@query("""WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: sqrt(abs(b.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))), 9) AS dist FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, list(id ORDER BY dist, id)[1:5]::VARCHAR AS ids FROM d GROUP BY query_id""")
def nearest_by_own_distance(spark, sf):
    """KNN06, UDF01: any function of two components makes a distance; the five nearest as a list."""
    e = embeddings(spark, sf)
    q = asked(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    dist = V.pairwise(F.col("embedding"), F.col("q"), lambda a, b: F.sqrt(F.abs(a - b)))
    pairs = e.crossJoin(knn.few(q)).select("query_id", F.col("vec_id").alias("id"), F.round(dist, 9).alias("dist"))
    return knn.nearest_lists(pairs, 5).select("query_id", F.concat(F.lit("["), F.array_join(F.transform("ids", lambda i: i.cast("string")), ", "), F.lit("]")).alias("ids"))


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 500 + 1 AS rows_, o_orderkey % 7 + 8 AS cols, o_totalprice / 1e6 AS secs FROM orders)
SELECT o_orderkey, round(rows_ * cols / secs, 3) AS throughput, rows_ * cols * 64 AS muls FROM t WHERE secs > 0""")
def speed_metrics(spark, sf):
    """MET10: outputs a second and multiplications of measured products, merged with their times."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 500 + 1).alias("n"), (F.col("o_orderkey") % 7 + 8).alias("m"), (F.col("o_totalprice").cast("double") / 1e6).alias("secs"))
    return metrics_of_speed(o.filter("secs > 0")).select("o_orderkey", F.round("throughput", 3).alias("throughput"), "muls")


def metrics_of_speed(rows, dim: int = 64):
    return rows.withColumns({"throughput": F.col("n") * F.col("m") / F.col("secs"), "muls": F.col("n") * F.col("m") * dim})
