"""Queries: windows, series, samples, splits (WIN, PRE17, SRC, SMP)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions import vector as V
from prismframe.operators import metrics, sampling, windows
from prismframe.operators.arrow import map_rows
from prismframe.plans.base import FLAT, cells, embeddings, query, table
from prismframe.sources import readers, synthetic

ORDER = ["ts", "event_id"]


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events")
def first_diff(spark, sf):
    """PRE17."""
    return windows.first_difference(table(spark, sf, "events"), "user_id", ORDER, "value").select("event_id", "user_id", F.round("diff", 6).alias("diff"))


@query("""SELECT event_id, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3, round(value, 6) AS y FROM (
  SELECT event_id, value, lag(value, 3) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 1) OVER w AS x3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND value IS NOT NULL""")
def ar_lag_matrix(spark, sf):
    """WIN04."""
    got = windows.lag_matrix(table(spark, sf, "events"), "user_id", ORDER, "value", 3)
    return got.select("event_id", *(F.round(F.col("x")[i], 6).alias(f"x{i + 1}") for i in range(3)), F.round("y", 6).alias("y"))


@query("""WITH d AS (SELECT value AS y, lag(value, 2) OVER w AS a, lag(value, 1) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT count(*)::DOUBLE AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS bby, covar_pop(y, y) AS yy FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
l AS (SELECT *, aa + 0.1 * (aa + bb) / 2 / n AS paa, bb + 0.1 * (aa + bb) / 2 / n AS pbb FROM s),
w AS (SELECT *, (pbb * ay - ab * bby) / (paa * pbb - ab * ab) AS w1, (paa * bby - ab * ay) / (paa * pbb - ab * ab) AS w2 FROM l)
SELECT n::BIGINT AS n, round(w1, 5) AS w1, round(w2, 5) AS w2, round(1 - (yy - 2 * (w1 * ay + w2 * bby) + w1 * w1 * aa + 2 * w1 * w2 * ab + w2 * w2 * bb) / yy, 5) AS r2 FROM w""")
def ar_fit(spark, sf):
    """WIN05."""
    design = windows.lag_matrix(table(spark, sf, "events"), "user_id", ORDER, "value", 2)
    got = windows.fit_autoregression(design.select("x", "y"), 2)
    row = (got["n"], *(round(w, 5) for w in got["weights"]), None if got["r2"] is None else round(got["r2"], 5))
    return spark.createDataFrame([row], "n long, w1 double, w2 double, r2 double")


@query("""SELECT event_id, round(a + b + c + d, 6) AS total, round(a, 6) AS first FROM (
  SELECT event_id, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c, lead(value, 3) OVER w AS d FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE d IS NOT NULL""")
def sliding_window_rows(spark, sf):
    """WIN01 over rows."""
    got = windows.row_windows(table(spark, sf, "events").filter("value IS NOT NULL"), "user_id", ORDER, "value", 4)
    return got.select("event_id", F.round(V.total(F.col("window")), 6).alias("total"), F.round(F.col("window")[0], 6).alias("first"))


@query(f"""WITH {FLAT} SELECT a.vec_id, w AS at, round(sum(a.x), 6) AS total, round(max(a.x), 6) AS top FROM flat a, (SELECT (w * 8)::INT AS s, w::INT AS w FROM range(7) t(w)) WHERE a.pos >= s AND a.pos < s + 16 GROUP BY a.vec_id, w""")
def array_windows(spark, sf):
    """WIN01, WIN02."""
    got = windows.stacked_windows(embeddings(spark, sf), "vec_id", "embedding", 16, 8)
    return got.select("vec_id", "at", F.round(V.total(F.transform("window", V.d)), 6).alias("total"), F.round(F.array_max("window").cast("double"), 6).alias("top"))


@query("""SELECT event_id, round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS filled FROM (
  SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)""")
def backfill(spark, sf):
    """SRC09: values of one kind of event are taken as missing."""
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return windows.back_fill(e, "user_id", ORDER, "v", "filled").select("event_id", F.round("filled", 6).alias("filled"))


@query(f"""WITH {FLAT}, p AS (SELECT a.vec_id, y * 6 + z AS "at", i - 1 AS di, j - 1 AS dj, a.x FROM flat a, range(6) r(y), range(6) s(z), range(3) t(i), range(3) u(j) WHERE a.pos = (y + i) * 8 + z + j)
SELECT vec_id, "at"::INT AS "at", round(sum(x * (CASE WHEN di = 0 THEN 2 ELSE 1 END) * dj * -1), 6) AS gx, round(sum(x * (CASE WHEN dj = 0 THEN 2 ELSE 1 END) * di * -1), 6) AS gy FROM p GROUP BY vec_id, "at" """)
def sobel_patches(spark, sf):
    """WIN03, WIN06-WIN08: each vector as an 8 x 8 image."""
    got = windows.convolve(embeddings(spark, sf), "vec_id", "embedding", 8, 8, windows.filter_bank("sobel"), 3)
    return got.select("vec_id", "at", F.round(F.col("out")[0], 6).alias("gx"), F.round(F.col("out")[1], 6).alias("gy"))


@query(f"""WITH {FLAT}, p AS (SELECT a.vec_id, y * 6 + z AS "at", i - 1 AS di, j - 1 AS dj, a.x, round(a.x, 1) AS r FROM flat a, range(6) q(y), range(6) s(z), range(3) t(i), range(3) u(j) WHERE a.pos = (y + i) * 8 + z + j),
g AS (SELECT vec_id, "at", sum(x * (CASE WHEN di = 0 THEN 2 ELSE 1 END) * dj) AS a, sum(x * (CASE WHEN dj = 0 THEN 2 ELSE 1 END) * di) AS b, sum(r * (CASE WHEN di = 0 THEN 2 ELSE 1 END) * dj) AS c, sum(r * (CASE WHEN dj = 0 THEN 2 ELSE 1 END) * di) AS d FROM p GROUP BY vec_id, "at")
SELECT round(avg(power(sqrt(a * a + b * b) - sqrt(c * c + d * d), 2)) / var_pop(sqrt(a * a + b * b)), 5) AS nmse FROM g""")
def gradient_nmse(spark, sf):
    """MET07: what rounding to one digit does to gradients."""
    e = embeddings(spark, sf).select("vec_id", F.transform("embedding", V.d).alias("embedding"))
    bank = windows.filter_bank("sobel")
    true = windows.convolve(e, "vec_id", "embedding", 8, 8, bank, 3).select("vec_id", "at", F.col("out").alias("a"))
    rounded = e.select("vec_id", F.transform("embedding", lambda x: F.round(x, 1)).alias("embedding"))
    near = windows.convolve(rounded, "vec_id", "embedding", 8, 8, bank, 3).select("vec_id", "at", F.col("out").alias("b"))
    return metrics.gradient_nmse(true.join(near, ["vec_id", "at"]), "a", "b").withColumn("nmse", F.round("nmse", 5))


# ---------------------------------------------------------------- samples and splits

KEY = "((vec_id * 48271 + 11) % 2147483647)"
LABEL_KEY = "((doc_id * 48271 + 11) % 2147483647)"


@query(f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), r AS (SELECT toxic, n, row_number() OVER (ORDER BY n, toxic) AS i FROM c),
first AS (SELECT toxic, n, least(n, greatest(1, floor(60 * n / (SELECT sum(n) FROM c) + 0.999)))::BIGINT AS take FROM r WHERE i = 1),
second AS (SELECT toxic, n, least(n, greatest(1, floor((60 - (SELECT take FROM first)) * n / n + 0.999)))::BIGINT AS take FROM r WHERE i = 2),
q AS (SELECT * FROM first UNION ALL SELECT * FROM second)
SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {LABEL_KEY}, doc_id) AS i FROM labels) JOIN q USING (toxic) WHERE i <= take""")
def class_balanced_sample(spark, sf):
    """SMP01: 60 rows in proportion to two classes, the rarer one first."""
    return sampling.balanced(table(spark, sf, "labels"), "toxic", "doc_id", 60).select("doc_id", "toxic")


@query(f"""SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}, vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5) AS is_test FROM embeddings""")
def stratified_split(spark, sf):
    """SMP02."""
    return sampling.stratified_split(embeddings(spark, sf), "label", "vec_id", 0.25).select("vec_id", "label", "is_test")


@query(f"SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {KEY}, vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def kfold(spark, sf):
    """SMP03."""
    return sampling.k_folds(embeddings(spark, sf), "label", "vec_id", 5).select("vec_id", "label", "fold")


@query(f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}, vec_id) AS i FROM embeddings) WHERE i <= 7")
def cap_per_class(spark, sf):
    """SMP04, FLT05: a limit is the feature here."""
    return sampling.first_per_class(embeddings(spark, sf), "label", "vec_id", 7).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 20")
def block_sample(spark, sf):
    """TRN13, FLT10: a stretch of rows is the feature here."""
    return sampling.block_sample(embeddings(spark, sf), "vec_id", 20, 50).select("vec_id", "label")


# ---------------------------------------------------------------- sources


@query(f"""WITH {FLAT}, m AS (SELECT vec_id, pos, CASE WHEN (vec_id + pos) % 5 = 0 THEN NULL ELSE x END AS x FROM flat), md AS (SELECT pos, quantile_cont(x, 0.5) AS m FROM m GROUP BY pos)
SELECT vec_id, pos::INT AS pos, round(coalesce(x, m), 6) AS x FROM m JOIN md USING (pos)""")
def fill_missing(spark, sf):
    """SRC07, FLT01: a fifth of all components is taken out; medians of positions take their place."""
    e = embeddings(spark, sf).select("vec_id", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 5 != 0, x.cast("double"))).alias("v"))
    return cells(readers.fill_missing(e, "v", "vec_id"), "vec_id", "v")


@query("SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS label FROM orders")
def reindex_labels(spark, sf):
    """SRC07."""
    return readers.reindex_labels(table(spark, sf, "orders"), "o_orderpriority", "label").select("o_orderkey", "o_orderpriority", "label")


@query("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms FROM events")
def unix_millis(spark, sf):
    """SRC09's clock."""
    return table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query()
def synthetic_vectors(spark, sf):
    """SRC04, SRC05: four kinds, 500 rows each."""
    out = None
    for kind in ("uniform", "gauss", "walk", "blobs"):
        part = synthetic.vectors(spark, 500, 16, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.union(part)
    return out


@query()
def resample_vectors(spark, sf):
    """PRE18."""
    return map_rows(embeddings(spark, sf), "embedding", ["vec_id"], [("resampled", T.ArrayType(T.DoubleType()), pa.float64())], lambda x: [windows.resample(x, 48)])
