"""Queries: exact and compressed search, codebooks, tables, scans (DST, KNN, PRE, TRN, VQ)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions import vector as V
from prismframe.operators import codebook, encoder, knn, linalg, lutquant, metrics, prototypes
from prismframe.operators.arrow import map_rows
from prismframe.plans.base import CENT, CENTROIDS, CODEBOOKS, CODES, FLAT, SPAN, asked, books, cells, dot, embeddings, l1, l2, query, ranked


def _knn(spark, sf, metric, k=10):
    e = embeddings(spark, sf)
    got = knn.exact_knn(e, asked(e), k, "vec_id", "vec_id", metric=metric)
    return got.select("query_id", "id", F.round("dist", 6).alias("dist"), "rank")


@query(ranked(l2("b.embedding", "q.embedding")))
def exact_l2_knn(spark, sf):
    """KNN03, DST01, DST04."""
    return _knn(spark, sf, "l2")


@query(ranked(dot("b.embedding", "q.embedding"), order="d DESC, id"))
def exact_dot_mips(spark, sf):
    """KNN05's exact counterpart, DST03."""
    return _knn(spark, sf, "dot")


@query(ranked(l1("b.embedding", "q.embedding")))
def exact_l1_knn(spark, sf):
    """DST02."""
    return _knn(spark, sf, "l1")


@query(ranked(f"{dot('b.embedding', 'q.embedding')} / sqrt({dot('b.embedding', 'b.embedding')} * {dot('q.embedding', 'q.embedding')})", order="d DESC, id"))
def cosine_topk(spark, sf):
    """DST09, PRE02."""
    return _knn(spark, sf, "cosine")


@query(f"SELECT q.vec_id AS query_id, b.vec_id AS id, round({l2('b.embedding', 'q.embedding')}, 6) AS dist FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0")
def l2_norm_expansion(spark, sf):
    """DST04 as a column expression."""
    e = embeddings(spark, sf)
    q = asked(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = e.join(knn.few(q), F.lit(True))
    return rows.select("query_id", F.col("vec_id").alias("id"), F.round(F.greatest(F.lit(0.0), knn.norm_expansion(rows, "embedding", "q")), 6).alias("dist"))


@query(f"""
SELECT query_id, id, round(d, 6) AS dist FROM (
  SELECT q.vec_id AS query_id, b.vec_id AS id, {l2('b.embedding', 'q.embedding')} AS d FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id)
WHERE d < 1.4""")
def radius_join(spark, sf):
    """KNN07, FLT07."""
    e = embeddings(spark, sf)
    return knn.radius_join(e, asked(e), 1.4, "vec_id", "vec_id").select("query_id", "id", F.round("dist", 6).alias("dist"))


MEANS = FLAT + ", means AS (SELECT label, pos, round(avg(x), 6) AS m FROM flat GROUP BY label, pos)"


def _centers(df):
    rows = prototypes.class_means(df, "label", "embedding").collect()
    return {r["label"]: [round(x, 6) for x in r["center"]] for r in rows}


@query(f"""WITH {MEANS}, s AS (
  SELECT vec_id, m.label, sum(m * m) - 2 * sum(x * m) AS s FROM flat JOIN means m USING (pos) GROUP BY vec_id, m.label)
SELECT vec_id, arg_min(label, (round(s, 12), label)) AS pred FROM s GROUP BY vec_id""")
def knn_1nn_label(spark, sf):
    """KNN09."""
    e = embeddings(spark, sf)
    return knn.nearest_center(e, _centers(e)).select("vec_id", "pred")


@query(f"""WITH {MEANS}, s AS (
  SELECT vec_id, m.label, sum((x - m) * (x - m)) AS d2 FROM flat JOIN means m USING (pos) GROUP BY vec_id, m.label)
SELECT vec_id, arg_min(label, (round(d2, 12), label)) AS pred FROM s GROUP BY vec_id""")
def knn_rbf_label(spark, sf):
    """KNN10; with one centre a class the vote goes to the nearest."""
    e = embeddings(spark, sf)
    centers = spark.createDataFrame([(k, k, v) for k, v in sorted(_centers(e).items())], "center_id int, label int, center array<double>")
    return knn.rbf_vote(e, centers).select("vec_id", "pred")


@query(f"""WITH {MEANS}, s AS (
  SELECT vec_id, m.label, sum(x * m) + m.label * 0.001 AS s FROM flat JOIN means m USING (pos) GROUP BY vec_id, m.label)
SELECT vec_id, arg_min(label, (-round(s, 12), label)) AS pred FROM s GROUP BY vec_id""")
def linear_argmax(spark, sf):
    """KNN11."""
    e = embeddings(spark, sf)
    w = _centers(e)
    return knn.linear_argmax(e, w, {c: c * 0.001 for c in w}).select("vec_id", "pred")


@query(f"""WITH {MEANS}, s AS (
  SELECT vec_id, m.label AS l, sum(m * m) - 2 * sum(x * m) AS s FROM flat JOIN means m USING (pos) GROUP BY vec_id, m.label
), p AS (SELECT vec_id, arg_min(l, (round(s, 12), l)) AS pred FROM s GROUP BY vec_id)
SELECT round(avg((pred = label)::INT), 6) AS accuracy, count(*) AS n FROM p JOIN embeddings USING (vec_id)""")
def classification_accuracy(spark, sf):
    """MET06."""
    e = embeddings(spark, sf)
    return metrics.accuracy(knn.nearest_center(e, _centers(e)), "pred", "label").withColumn("accuracy", F.round("accuracy", 6))


# ---------------------------------------------------------------- preprocessing


@query(f"""WITH {FLAT}, mu AS (SELECT pos, avg(x) AS m FROM flat GROUP BY pos), c AS (SELECT vec_id, pos, x - m AS x FROM flat JOIN mu USING (pos)),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM c GROUP BY vec_id), u AS (SELECT vec_id, pos, x / n AS x FROM c JOIN n USING (vec_id)),
places AS (SELECT p::INT AS p, CASE WHEN p < 72 AND p % 9 < 8 THEN p // 9 * 8 + p % 9 ELSE -1 END AS src FROM range(72) t(p))
SELECT v.vec_id, p AS pos, round(coalesce(u.x, 0), 6) AS x FROM (SELECT DISTINCT vec_id FROM flat) v CROSS JOIN places LEFT JOIN u ON u.vec_id = v.vec_id AND u.pos = src""")
def center_norm_pad(spark, sf):
    """PRE01, PRE02, PRE03: centred by column means, normalised, padded from 64 to 72 columns by 8 zeros, one behind each stripe."""
    e = embeddings(spark, sf)
    mean = linalg.column_means(e, "embedding")
    v = V.normalize(V.center(F.col("embedding"), V.literal(mean)))
    out = e.select("vec_id", v.alias("v"))
    return cells(out.select("vec_id", V.gather(F.col("v"), V.padded(64, 72)).alias("v")), "vec_id", "v")


@query(f"WITH {FLAT} SELECT vec_id, pos // 4 AS subspace, round(sum(x), 6) AS total FROM flat GROUP BY ALL")
def subspace_slice(spark, sf):
    """PRE07, PRE08."""
    e = embeddings(spark, sf).select("vec_id", F.posexplode(V.subspaces(F.col("embedding"), V.even_spans(64, 16))).alias("subspace", "v"))
    return e.select("vec_id", F.col("subspace").cast("long").alias("subspace"), F.round(V.total(F.transform("v", V.d)), 6).alias("total"))


PERM = [(j * 37 + 5) % 64 for j in range(64)]


@query(f"WITH {FLAT} SELECT vec_id, i AS pos, round(x, 6) AS x FROM flat JOIN (SELECT i::INT AS i, (i * 37 + 5) % 64 AS p FROM range(64) t(i)) ON pos = p")
def permute(spark, sf):
    """PRE04, PRE19: a permutation; its inverse's inverse is itself."""
    perm = V.inverse_permutation(V.inverse_permutation(PERM))
    return cells(embeddings(spark, sf).select("vec_id", V.gather(F.col("embedding"), perm).alias("v")), "vec_id", "v")


@query(f"""WITH {FLAT} SELECT vec_id, i AS pos, round(sum(x * CASE WHEN bit_count(i & pos) % 2 = 0 THEN 0.125 ELSE -0.125 END), 6) AS x
FROM flat, (SELECT i::INT AS i FROM range(64) t(i)) GROUP BY vec_id, i""")
def rotate_fixed(spark, sf):
    """PRE05: rotation by the Hadamard matrix."""
    h = (np.array(V.hadamard(64, 64)) / 8).tolist()
    return cells(embeddings(spark, sf).select("vec_id", V.rotate(F.col("embedding"), h).alias("v")), "vec_id", "v")


@query(f"""WITH {FLAT} SELECT vec_id, (b * 16 + i)::INT AS pos, round(sum(x * CASE WHEN bit_count(i & (pos % 16)) % 2 = 0 THEN 0.25 ELSE -0.25 END), 6) AS x
FROM flat JOIN (SELECT b, i FROM range(4) t(b), range(16) u(i)) ON pos // 16 = b GROUP BY vec_id, b, i""")
def rotate_blocks(spark, sf):
    """PRE06."""
    h = (np.array(V.hadamard(16, 16)) / 4).tolist()
    return cells(embeddings(spark, sf).select("vec_id", V.rotate_blocks(F.col("embedding"), [h] * 4).alias("v")), "vec_id", "v")


@query(f"""WITH {FLAT}, s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM flat GROUP BY vec_id)
SELECT vec_id, pos::INT AS pos, round((x - m) / (sd + 1e-20), 6) AS x FROM flat JOIN s USING (vec_id)""")
def z_normalize(spark, sf):
    """PRE22."""
    return cells(embeddings(spark, sf).select("vec_id", V.z_normalize(F.col("embedding")).alias("v")), "vec_id", "v")


@query(f"""WITH {FLAT}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM flat)
SELECT vec_id, pos::INT AS pos, round((x - m) / sd, 6) AS x FROM flat, s""")
def precondition(spark, sf):
    """PRE23: by the mean and deviation of all values."""
    e = embeddings(spark, sf)
    s = e.select(F.explode("embedding").alias("x")).agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    rows = e.crossJoin(F.broadcast(s))  # one row
    return cells(rows.select("vec_id", F.transform("embedding", lambda x: (x.cast("double") - F.col("m")) / F.col("sd")).alias("v")), "vec_id", "v")


@query(f"""WITH {FLAT}, s AS (SELECT vec_id, round(min(x), 9) AS lo, round(max(x), 9) AS hi FROM flat GROUP BY vec_id)
SELECT vec_id, pos::INT AS pos, least(255, greatest(0, floor(round((x - lo) * 255 / (hi - lo), 6))))::INT AS q FROM flat JOIN s USING (vec_id)""")
def scalar_quantize_rows(spark, sf):
    """PRE09 by rows."""
    e = embeddings(spark, sf).select("vec_id", F.transform("embedding", V.d).alias("v"))
    e = e.withColumns({"lo": F.round(F.array_min("v"), 9), "hi": F.round(F.array_max("v"), 9)})
    rows = e.select("vec_id", "lo", "hi", F.posexplode("v").alias("pos", "x"))
    return rows.select("vec_id", "pos", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round((F.col("x") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")), 6)).cast("int"))).alias("q"))


@query(f"""WITH {FLAT}, s AS (SELECT pos, round(min(x), 9) AS lo, round(max(x), 9) AS hi FROM flat GROUP BY pos)
SELECT vec_id, pos::INT AS pos, (least(255, greatest(0, floor(round((x - lo) * 255 / (hi - lo), 6)))) - 128)::INT AS q FROM flat JOIN s USING (pos)""")
def scalar_quantize_cols(spark, sf):
    """PRE09 by columns, signed."""
    rows = embeddings(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    s = rows.groupBy("pos").agg(F.round(F.min("x"), 9).alias("lo"), F.round(F.max("x"), 9).alias("hi"))
    rows = rows.join(F.broadcast(s), "pos")  # a row a column
    q = F.floor(F.round((F.col("x") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")), 6)).cast("int")
    return rows.select("vec_id", "pos", (F.least(F.lit(255), F.greatest(F.lit(0), q)) - 128).alias("q"))


@query("""WITH s AS (SELECT round(max(l_extendedprice), 2) AS hi, round(min(l_extendedprice), 2) AS lo FROM lineitem)
SELECT l_orderkey, l_linenumber, least(255, floor(round((l_extendedprice - lo) / (hi - lo) * 255, 6)))::INT AS q FROM lineitem, s""")
def global_quantize(spark, sf):
    """PRE10."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = t.agg(F.round(F.max("l_extendedprice"), 2).alias("hi"), F.round(F.min("l_extendedprice"), 2).alias("lo"))
    q = F.floor(F.round((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, 6)).cast("int")
    return t.crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", F.least(F.lit(255), q).alias("q"))


@query("""SELECT l_orderkey, l_linenumber, d, CASE WHEN d > 0 THEN 2 * d - 1 ELSE -2 * d END AS z, d AS back FROM (
  SELECT l_orderkey, l_linenumber, (l_partkey - l_suppkey * 10) AS d FROM lineitem)""")
def zigzag(spark, sf):
    """PRE11, both ways."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - F.col("l_suppkey") * 10).alias("d"))
    t = t.withColumn("z", V.zigzag(F.col("d")))
    return t.withColumn("back", V.unzigzag(F.col("z")))


@query("""SELECT l_orderkey, l_linenumber, d,
  CASE WHEN d = 0 THEN 0 WHEN d > 0 THEN length(format('{:b}', d)) + 1 WHEN d = -1 THEN 1 ELSE length(format('{:b}', -d - 1)) + 1 END::INT AS signed_bits,
  CASE WHEN d = 0 THEN 0 ELSE length(format('{:b}', abs(d))) END::INT AS unsigned_bits
FROM (SELECT l_orderkey, l_linenumber, (l_partkey - l_suppkey * 10) AS d FROM lineitem)""")
def nbits_cost(spark, sf):
    """PRE12."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - F.col("l_suppkey") * 10).alias("d"))
    return t.select("*", V.nbits_signed(F.col("d")).alias("signed_bits"), V.nbits_unsigned(F.abs("d")).alias("unsigned_bits"))


BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(format('{{:b}}', {0})) END"


@query(f"""WITH r AS (
  SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 8 AS block, l_quantity::BIGINT - CASE WHEN l_suppkey % 2 = 0 THEN 25 ELSE 0 END AS a, l_linenumber::BIGINT AS b FROM lineitem
), s AS (SELECT l_suppkey, min(least(a, b)) < 0 AS signed FROM r GROUP BY l_suppkey),
z AS (SELECT l_suppkey, block, CASE WHEN NOT signed THEN a WHEN a > 0 THEN 2 * a - 1 ELSE -2 * a END AS a, CASE WHEN NOT signed THEN b WHEN b > 0 THEN 2 * b - 1 ELSE -2 * b END AS b FROM r JOIN s USING (l_suppkey)),
m AS (SELECT l_suppkey, block, max({BITS.format('a')}) AS a, max({BITS.format('b')}) AS b FROM z GROUP BY ALL),
c AS (SELECT l_suppkey, block, CASE WHEN a = 15 THEN 16 ELSE a END + CASE WHEN b = 15 THEN 16 ELSE b END AS bits FROM m),
p AS (SELECT *, lag(bits) OVER (PARTITION BY l_suppkey ORDER BY block) AS before FROM c)
SELECT l_suppkey, sum(CASE WHEN bits > 0 THEN bits + 1 WHEN before = 0 THEN 0 ELSE 1 END)::BIGINT AS bytes FROM p GROUP BY l_suppkey""")
def packed_size(spark, sf):
    """MET08, a series a supplier; those with even numbers have negative values."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    t = t.select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), (F.col("l_quantity").cast("long") - F.when(F.col("l_suppkey") % 2 == 0, 25).otherwise(0)).alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    return metrics.packed_size(t, F.col("o"), ["a", "b"], True, ["l_suppkey"])


# ---------------------------------------------------------------- codebooks, tables, scans


def _given(spark, sf, **spec):
    e = embeddings(spark, sf)
    spec = {"quantize": "none"} | spec
    return e, encoder.fixed(books(e), encoder.Spec(n_codebooks=CODEBOOKS, k=CENTROIDS, **spec))


@query(f"WITH {CODES} SELECT vec_id, c::INT AS codebook, code::INT AS code FROM codes")
def pq_encode_fixed(spark, sf):
    """VQ01."""
    e, m = _given(spark, sf)
    return m.encode(e).select("vec_id", F.posexplode("codes").alias("codebook", "code")).select("vec_id", "codebook", F.col("code").cast("int").alias("code"))


@query(f"""WITH {CENT}, cell AS (SELECT vec_id, c, k, round(sum(power(round(x * 100) - round(y * 100), 2))) AS d2 FROM flat JOIN cent USING (pos) GROUP BY vec_id, c, k)
SELECT vec_id, c::INT AS codebook, arg_min(k, (d2, k))::INT AS code FROM cell GROUP BY vec_id, c""")
def pq_encode_rounded(spark, sf):
    """VQ02: distances rounded to whole numbers decide, with ties to the smaller code; components and centroids in whole hundredths."""
    e = embeddings(spark, sf)
    given = [np.floor(np.abs(b) * 100 + 0.5) * np.sign(b) for b in books(e)]
    whole = e.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 100)).alias("embedding"))
    spans = V.even_spans(CODEBOOKS * SPAN, CODEBOOKS)
    made = map_rows(whole, "embedding", ["vec_id"], [("codes", T.ArrayType(T.IntegerType()), pa.int32())], lambda x: [codebook.encode(x, given, spans, rounded=True)])
    return made.select("vec_id", F.posexplode("codes").alias("codebook", "code"))


@query("""SELECT vec_id, s::INT AS subspace, n::INT AS n, round(list_sum(list_transform(embedding[a + 1 : a + n], lambda x: x::DOUBLE)), 6) AS total FROM embeddings,
  (SELECT s, CASE WHEN s < 4 THEN 11 * s ELSE 44 + 10 * (s - 4) END AS a, CASE WHEN s < 4 THEN 11 ELSE 10 END AS n FROM range(6) t(s))""")
def subspace_slice_uneven(spark, sf):
    """PRE08: six subspaces of 64 components, the four wider ones first."""
    parts = V.subspaces(F.col("embedding"), V.even_spans(64, 6))
    rows = embeddings(spark, sf).select("vec_id", F.posexplode(parts).alias("subspace", "part"))
    return rows.select("vec_id", "subspace", F.size("part").alias("n"), F.round(V.total(F.transform("part", V.d)), 6).alias("total"))


WIDE = FLAT + """, cent AS (SELECT pos // 8 AS c, pos, vec_id AS k, x AS y FROM flat WHERE vec_id < 256),
cell AS (SELECT f.vec_id, c, k, sum((x - y) * (x - y)) AS d2, sum(x * y) AS dot FROM flat f JOIN cent USING (pos) GROUP BY f.vec_id, c, k),
codes AS (SELECT vec_id, c, arg_min(k, (round(d2, 9), k)) AS code FROM cell GROUP BY vec_id, c)"""


def _wide(spark, sf, **spec):
    """Eight subspaces, whose 256 centroids are the vectors with the smallest ids: a code of 8 bits each."""
    e = embeddings(spark, sf)
    rows = e.filter("vec_id < 256").orderBy("vec_id").collect()  # 256 at most
    x = np.array([r["embedding"] for r in rows], np.float64)
    return e, encoder.fixed([x[:, 8 * c : 8 * c + 8] for c in range(8)], encoder.Spec(n_codebooks=8, k=len(rows), quantize="none", **spec))


@query(f"WITH {WIDE} SELECT vec_id, c::INT AS codebook, code::INT AS code FROM codes")
def wide_encode_fixed(spark, sf):
    """VQ03: 256 given centroids a codebook."""
    e, m = _wide(spark, sf)
    return m.encode(e).select("vec_id", F.posexplode("codes").alias("codebook", "code")).select("vec_id", "codebook", F.col("code").cast("int").alias("code"))


@query(f"WITH {WIDE}, lut AS (SELECT vec_id AS query_id, c, k, d2 FROM cell WHERE vec_id % 50 = 0) SELECT query_id, vec_id AS id, round(sum(d2), 6) AS dist FROM codes JOIN lut ON lut.c = codes.c AND lut.k = codes.code GROUP BY ALL")
def wide_scan(spark, sf):
    """VQ09, VQ11, VQ15: codes of 8 bits against the tables of all queries."""
    e, m = _wide(spark, sf)
    return m.transform(m.encode(e), asked(e)).select("query_id", "id", F.round("dist", 6).alias("dist"))


@query(f"WITH {WIDE}, t AS (SELECT c, k, m, sum(y * ((pos * 7 + m * 13) % 17 - 8) / 8.0::DOUBLE) AS t FROM cent, range(8) u(m) GROUP BY c, k, m) SELECT vec_id, m::INT AS pos, round(sum(t), 6) AS x FROM codes JOIN t ON t.c = codes.c AND t.k = codes.code GROUP BY vec_id, m")
def matmul_wide(spark, sf):
    """AMM21: a matrix product by codes of 256 centroids."""
    e, m = _wide(spark, sf, reduction="dot")
    b = [(j, [((i * 7 + j * 13) % 17 - 8) / 8 for i in range(64)]) for j in range(8)]
    got = m.transform(m.encode(e), spark.createDataFrame(b, "vec_id int, embedding array<double>"))
    return got.select(F.col("id").alias("vec_id"), F.col("query_id").alias("pos"), F.round("dist", 6).alias("x"))


@query(f"""WITH {FLAT}, p AS (SELECT vec_id AS center_id, label, pos, x AS y FROM flat WHERE vec_id < 40),
d AS (SELECT f.vec_id, center_id, p.label, sum(power(x - y, 2)) AS d2 FROM flat f JOIN p USING (pos) GROUP BY f.vec_id, center_id, p.label),
w AS (SELECT vec_id, label, sum(exp(-2 * d2)) AS w FROM d GROUP BY vec_id, label) SELECT vec_id, arg_min(label, (-w, label)) AS pred FROM w GROUP BY vec_id""")
def rbf_vote(spark, sf):
    """KNN10: votes of forty centres, several of a label."""
    e = embeddings(spark, sf)
    centers = e.filter("vec_id < 40").select(F.col("vec_id").alias("center_id"), "label", F.transform("embedding", V.d).alias("center"))
    return knn.rbf_vote(e, centers, 2.0)


@query(f"""WITH {FLAT}, d AS (SELECT vec_id, sum(power(x - 0.1::DOUBLE, 2)) AS d FROM flat GROUP BY vec_id) SELECT vec_id AS id, round(d, 6) AS dist, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM d ORDER BY d, vec_id LIMIT 10""")
def knn_of_one_query(spark, sf):
    """KNN01, KNN02, KNN08: the ten nearest rows of one given vector; the report of ten is the feature."""
    one = spark.createDataFrame([(0, [0.1] * 64)], "vec_id long, embedding array<double>")
    return knn.exact_knn(embeddings(spark, sf), one, 10, "vec_id", "vec_id").select("id", F.round("dist", 6).alias("dist"), "rank")


@query("""SELECT vec_id, i::INT AS pos, greatest(-128, least(127, round_even(x::DOUBLE * 300, 0)))::INT AS i8, greatest(0, least(255, floor((x::DOUBLE + 0.2) * 500)))::INT AS u8
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)""")
def saturating_pack(spark, sf):
    """PRE14: components as signed and as unsigned bytes; what is beyond stays at the border."""
    rows = embeddings(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.select("vec_id", "pos", V.saturate_i8(F.col("x") * 300).alias("i8"), V.affine_u8(F.col("x"), -0.2, 500.0).alias("u8"))


@query(f"""WITH {CODES}, r AS (SELECT vec_id, pos, x, y FROM flat JOIN codes ON codes.vec_id = flat.vec_id AND codes.c = flat.pos // 4 JOIN cent ON cent.pos = flat.pos AND cent.k = codes.code)
SELECT round(avg((x - y) * (x - y)), 8) AS mse, round(var_pop(x), 8) AS variance, round(avg((x - y) * (x - y)) / var_pop(x), 6) AS share FROM r""".replace("SELECT vec_id, pos, x, y FROM flat", "SELECT flat.vec_id, flat.pos, x, y FROM flat"))
def pq_reconstruct_mse(spark, sf):
    """TRN14, TRN15."""
    e, m = _given(spark, sf)
    rows = e.join(m.encode(e), "vec_id").select(F.explode(F.arrays_zip(F.col("embedding").alias("x"), codebook.reconstruct(F.col("codes"), m.books).alias("y"))).alias("p"))
    rows = rows.select(F.col("p.x").cast("double").alias("x"), F.col("p.y").alias("y"))
    mse, var = F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))), F.var_pop("x")
    return rows.agg(F.round(mse, 8).alias("mse"), F.round(var, 8).alias("variance"), F.round(mse / var, 6).alias("share"))


def _entries(m, e):
    t = m.luts(asked(e)).select("query_id", F.posexplode("lut").alias("at", "x"))
    return t.select("query_id", F.floor(F.col("at") / CENTROIDS).cast("int").alias("codebook"), (F.col("at") % CENTROIDS).cast("int").alias("centroid"), "x")


@query(f"WITH {CODES} SELECT vec_id AS query_id, c::INT AS codebook, k::INT AS centroid, round(d2, 6) AS x FROM cell WHERE vec_id % 50 = 0")
def lut_float_l2(spark, sf):
    """VQ12, VQ16."""
    e, m = _given(spark, sf)
    return _entries(m, e).withColumn("x", F.round("x", 6))


@query(f"WITH {CODES} SELECT vec_id AS query_id, c::INT AS codebook, k::INT AS centroid, round(dot, 6) AS x FROM cell WHERE vec_id % 50 = 0")
def lut_float_dot(spark, sf):
    """VQ12 for products, MIT16's narrow form."""
    e, m = _given(spark, sf, reduction="dot")
    return _entries(m, e).withColumn("x", F.round("x", 6))


QUANT = CODES + """, lut AS (
  SELECT vec_id AS query_id, c, k, least(255, greatest(0, floor(round(d2, 9) * 200)))::INT AS v FROM cell WHERE vec_id % 50 = 0
), hits AS (
  SELECT query_id, vec_id AS id, codes.c, v FROM codes JOIN lut ON lut.c = codes.c AND lut.k = codes.code
)"""


def _quantized(spark, sf):
    """Codes, and tables of integers with offset 0 and scale 200, so that sums of 16 entries reach 255."""
    e, m = _given(spark, sf)
    lut = m.luts(asked(e)).select("query_id", F.transform("lut", lambda x: V.affine_u8(F.round(x, 9), 0.0, 200.0)).alias("lut"))
    return m.encode(e).crossJoin(knn.few(lut))


@query(f"WITH {QUANT} SELECT query_id, c::INT AS codebook, k::INT AS centroid, v AS x FROM lut")
def lut_quantized_u8(spark, sf):
    """VQ13, VQ14."""
    e, m = _given(spark, sf)
    return _entries(m, e).withColumn("x", V.affine_u8(F.round("x", 9), 0.0, 200.0))


@query(f"""WITH {QUANT}, w AS (SELECT query_id, id, list(v ORDER BY c) AS v FROM hits GROUP BY query_id, id),
t AS (SELECT query_id, id, list_sum(v) AS s, v,
  list_transform(range(0, 8), lambda i: (v[2 * i + 1] + v[2 * i + 2] + 1) // 2) AS a, list_sum(list_transform(range(0, 8), lambda i: least(255, v[2 * i + 1] + v[2 * i + 2]))) AS p FROM w),
u AS (SELECT *, list_transform(range(0, 4), lambda i: (a[2 * i + 1] + a[2 * i + 2] + 1) // 2) AS b FROM t),
x AS (SELECT *, list_transform(range(0, 2), lambda i: (b[2 * i + 1] + b[2 * i + 2] + 1) // 2) AS d FROM u)
SELECT query_id, id, s::INT AS safe, least(255, s)::INT AS u8, p::INT AS pairs, least(255, s)::INT AS grouped, ((d[1] + d[2] + 1) // 2 * 16 - 16)::INT AS mean FROM x""")
def scan_modes(spark, sf):
    """VQ05-VQ07, VQ17: the accumulations side by side."""
    c, t, n = F.col("codes"), F.col("lut"), CODEBOOKS
    return _quantized(spark, sf).select(
        "query_id", F.col("vec_id").alias("id"), V.lut_sum(c, t, n).alias("safe"), V.lut_sum_u8(c, t, n).alias("u8"), V.lut_sum_pairs(c, t, n).alias("pairs"),
        V.lut_sum_grouped(c, t, n).alias("grouped"), V.lut_mean(c, t, n).alias("mean"),
    )


@query(f"""WITH {QUANT}, s AS (
  SELECT query_id, id, list_reduce(list_prepend(0, list((v - 12) ORDER BY c)), lambda a, b: greatest(-128, least(127, a + b))) AS signed FROM hits GROUP BY query_id, id)
SELECT query_id, id, signed::INT AS signed FROM s""")
def scan_signed(spark, sf):
    """VQ08: signed entries, saturating in code order."""
    rows = _quantized(spark, sf).withColumn("lut", F.transform("lut", lambda x: x - 12))
    return rows.select("query_id", F.col("vec_id").alias("id"), V.lut_sum_signed(F.col("codes"), F.col("lut"), CODEBOOKS).alias("signed"))


SCAN = CODES + """, scan AS (
  SELECT l.vec_id AS query_id, codes.vec_id AS id, sum(l.{0}) AS d FROM codes JOIN cell l ON l.c = codes.c AND l.k = codes.code AND l.vec_id % 50 = 0 GROUP BY ALL
)"""


def _top(order):
    return f"SELECT query_id, id, round(d, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INT AS rank FROM scan) WHERE rank <= 10"


@query(f"WITH {SCAN.format('d2')} {_top('round(d, 9), id')}")
def vq_knn_l2(spark, sf):
    """KNN04, VQ05, VQ19: encode, look up, scan, keep the ten nearest."""
    e, m = _given(spark, sf)
    return m.knn(m.encode(e), asked(e), 10).select("query_id", "id", F.round("dist", 6).alias("dist"), "rank")


@query(f"WITH {SCAN.format('dot')} {_top('round(d, 9) DESC, id')}")
def vq_mips(spark, sf):
    """KNN05."""
    e, m = _given(spark, sf, reduction="dot")
    return m.knn(m.encode(e), asked(e), 10).select("query_id", "id", F.round("dist", 6).alias("dist"), "rank")


@query(f"WITH {QUANT} SELECT query_id, id, sum(v)::INT AS dist_q, round(sum(v) / 200.0, 6) AS dist FROM hits GROUP BY query_id, id")
def unquantize(spark, sf):
    """VQ18, MIT09's counterpart: sums of integers taken back to distances."""
    rows = _quantized(spark, sf).select("query_id", F.col("vec_id").alias("id"), V.lut_sum(F.col("codes"), F.col("lut"), CODEBOOKS).alias("dist_q"))
    return rows.withColumn("dist", F.round(F.col("dist_q") / 200.0, 6))


_FLOORS = ", ".join(f"quantile_cont(x, {a}) AS f{i}" for i, a in enumerate(lutquant.ALPHAS))
_GRID = " UNION ALL ".join(
    f"SELECT {a}::DOUBLE AS alpha, x, f{i} AS f, greatest(0, x - f{i}) AS o, (SELECT quantile_cont(greatest(0, x - f{i}), {1 - a}) FROM lut JOIN fl USING (c)) AS top FROM lut JOIN fl USING (c)"
    for i, a in enumerate(lutquant.ALPHAS)
)


@query(f"""WITH {CODES}, lut AS (SELECT c, d2 AS x FROM cell WHERE vec_id % 50 = 0), fl AS (SELECT c, {_FLOORS} FROM lut GROUP BY c), g AS ({_GRID})
SELECT alpha, round(255 / top, 4) AS scale, round(sum(power(x - f - least(255, floor(o * (255 / top))) / (255 / top), 2)), 6) AS loss FROM g GROUP BY alpha, top""")
def lut_quant_grid(spark, sf):
    """TRN12: the loss of every share in the grid."""
    e, m = _given(spark, sf)
    rows = lutquant.grid_table(_entries(m, e).select("codebook", "x"))
    return rows.select("alpha", F.round("scale", 4).alias("scale"), F.round("loss", 6).alias("loss"))


@query(f"""WITH {FLAT}, bits AS (SELECT vec_id, list((x > 0)::INT ORDER BY pos) AS b FROM flat GROUP BY vec_id), h AS (
  SELECT q.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: (b.b[i] <> q.b[i])::INT))::INT AS dist FROM bits b, bits q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)::INT AS rank FROM h) WHERE rank <= 10""")
def hamming_topk(spark, sf):
    """DST06-DST08: signs packed in one BIGINT, differing bits counted."""
    e = embeddings(spark, sf)
    bits = F.transform("embedding", lambda x: (x > 0).cast("int"))
    b = e.select("vec_id", F.array(V.pack_long(F.slice(bits, 1, 32), 32, 1), V.pack_long(F.slice(bits, 33, 32), 32, 1)).alias("b"))
    q = asked(b).select(F.col("vec_id").alias("query_id"), F.col("b").alias("q"))
    rows = b.join(knn.few(q), F.lit(True)).select("query_id", F.col("vec_id").alias("id"), V.hamming_bits(F.col("b"), F.col("q")).alias("dist"))
    return knn.top_k(rows, "query_id", [F.col("dist"), F.col("id")], 10)


@query(f"""WITH {CODES} SELECT vec_id, c::INT AS byte, (max(code) FILTER (h = 0) + 16 * max(code) FILTER (h = 1))::INT AS packed, max(code) FILTER (h = 0)::INT AS low, max(code) FILTER (h = 1)::INT AS high
FROM (SELECT vec_id, c // 2 AS c, c % 2 AS h, code FROM codes) GROUP BY vec_id, c""")
def pack_codes(spark, sf):
    """PRE15: two codes a byte, and back."""
    e, m = _given(spark, sf)
    rows = m.encode(e).select("vec_id", V.pack_nibbles(F.col("codes").cast("array<int>"), CODEBOOKS).alias("p"))
    rows = rows.select("vec_id", "p", V.unpack_nibbles(F.col("p"), CODEBOOKS).alias("u"))
    rows = rows.select("vec_id", "u", F.posexplode("p").alias("byte", "packed"))
    return rows.select("vec_id", "byte", "packed", F.col("u")[F.col("byte") * 2].alias("low"), F.col("u")[F.col("byte") * 2 + 1].alias("high"))


@query(f"""WITH {CODES} SELECT codes.c::INT AS codebook, code::INT AS code, (pos % 4)::INT AS j, round(avg(x), 6) AS x
FROM flat JOIN codes ON codes.vec_id = flat.vec_id AND codes.c = pos // 4 GROUP BY codes.c, code, pos""")
def centroid_update(spark, sf):
    """TRN04."""
    e, m = _given(spark, sf)
    new = codebook.centroid_update(e.join(m.encode(e), "vec_id"), "embedding", "codes", SPAN)
    return new.select("codebook", F.col("code").cast("int").alias("code"), F.posexplode("center").alias("j", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {CENT}, d AS (SELECT vec_id, k, sum((x - y) * (x - y)) AS d2 FROM flat JOIN cent USING (pos) GROUP BY vec_id, k),
a AS (SELECT vec_id, arg_min(k, (d2, k)) AS cluster FROM d GROUP BY vec_id)
SELECT cluster, count(*) OVER (PARTITION BY cluster, pos) AS n, pos::INT AS j, x FROM (
  SELECT cluster, pos, round(avg(x), 6) AS x, count(*) AS n FROM flat JOIN a USING (vec_id) GROUP BY cluster, pos)""".replace("count(*) OVER (PARTITION BY cluster, pos) AS n", "n"))
def kmeans_lloyd_step(spark, sf):
    """TRN01: one round over whole vectors from the given centroids."""
    e = embeddings(spark, sf)
    centers = np.hstack(books(e))
    got = codebook.lloyd_step(e, "embedding", centers)
    return got.select("cluster", "n", F.posexplode("center").alias("j", "x")).withColumn("x", F.round("x", 6))


# ---------------------------------------------------------------- retrieval quality


PAIRS = CODES + f""", exact AS (
  SELECT * FROM ({ranked(l2('b.embedding', 'q.embedding'))})
), scan AS (
  SELECT l.vec_id AS query_id, codes.vec_id AS id, round(sum(l.d2), 9) AS d FROM codes JOIN cell l ON l.c = codes.c AND l.k = codes.code AND l.vec_id % 50 = 0 GROUP BY ALL
), approx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM scan)"""


def _both(spark, sf):
    e, m = _given(spark, sf)
    exact = knn.exact_knn(e, asked(e), 10, "vec_id", "vec_id")
    scanned = m.transform(m.encode(e), asked(e)).withColumn("dist", F.round("dist", 9))
    return exact, scanned


@query(f"""WITH {PAIRS}, t AS (SELECT e.query_id, a.rank FROM exact e JOIN approx a ON a.query_id = e.query_id AND a.id = e.id WHERE e.rank = 1)
SELECT r::INT AS r, round(avg((rank <= r)::INT), 6) AS recall FROM t, (SELECT unnest([1, 5, 10, 50, 100]) AS r) GROUP BY r""")
def recall_at_r(spark, sf):
    """MET02."""
    exact, scanned = _both(spark, sf)
    return metrics.recall_at(knn.top_k(scanned, "query_id", [F.col("dist"), F.col("id")], 100), exact, [1, 5, 10, 50, 100]).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {PAIRS} SELECT e.query_id, round(count(a.id) / 10.0, 6) AS precision FROM exact e LEFT JOIN approx a ON a.query_id = e.query_id AND a.id = e.id AND a.rank <= 10 GROUP BY e.query_id""")
def precision_at_k(spark, sf):
    """MET03."""
    exact, scanned = _both(spark, sf)
    return metrics.precision_at(knn.top_k(scanned, "query_id", [F.col("dist"), F.col("id")], 10), exact, 10).withColumn("precision", F.round("precision", 6))


@query(f"""WITH {PAIRS}, t AS (SELECT s.query_id, max(d) AS top FROM scan s JOIN exact e ON e.query_id = s.query_id AND e.id = s.id GROUP BY s.query_id),
f AS (SELECT query_id, avg((d <= top)::INT) AS share FROM scan JOIN t USING (query_id) GROUP BY query_id)
SELECT round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std, round(quantile_cont(share, 0.5), 6) AS p50, round(quantile_cont(share, 0.9), 6) AS p90 FROM f""")
def frac_below_max(spark, sf):
    """MET04."""
    exact, scanned = _both(spark, sf)
    got = metrics.share_below_farthest(scanned, exact, 10)
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(f"""WITH {PAIRS}, p AS (SELECT query_id, id, d, {l2('b.embedding', 'q.embedding')} AS t FROM scan JOIN embeddings b ON b.vec_id = id JOIN embeddings q ON q.vec_id = query_id WHERE id <> query_id),
r AS (SELECT *, (d - t) / t AS rel FROM p)
SELECT round(corr(t, d), 5) AS corr, round(avg(rel), 5) AS rel_mean, round(stddev_pop(rel), 5) AS rel_std, round(avg(rel * rel), 5) AS rel2_mean, round(avg(power(t - d, 2)), 5) AS mse, count(rel) AS n FROM r""")
def error_stats(spark, sf):
    """MET05, DST10, FLT01."""
    e, m = _given(spark, sf)
    scanned = m.transform(m.encode(e), asked(e))
    q = asked(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = scanned.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id").join(q, "query_id").filter("id <> query_id")
    got = metrics.error_stats(pairs.withColumn("true", V.l2(F.col("embedding"), F.col("q"))), "true", "dist")
    return got.select(*(F.round(c, 5).alias(c) for c in got.columns if c != "n"), "n")


# ---------------------------------------------------------------- learned models: tests hold them against thresholds


def _learned(spark, sf, **spec):
    e = embeddings(spark, sf)
    return e, encoder.fit(e, encoder.Spec(**spec))


@query()
def learned_encoder_knn(spark, sf):
    """VQ19, TRN03, TRN12: trained on a sample, ten nearest by 16-byte codes."""
    e, m = _learned(spark, sf, n_codebooks=32)
    return m.knn(m.encode(e), asked(e), 10)


@query()
def learned_encoder_mips(spark, sf):
    """VQ19 for products."""
    e, m = _learned(spark, sf, n_codebooks=32, reduction="dot")
    return m.knn(m.encode(e), asked(e), 10)


@query()
def learned_wide_codes(spark, sf):
    """VQ03, VQ11, VQ15: 256 centroids, float tables."""
    e, m = _learned(spark, sf, n_codebooks=8, k=256, quantize="none")
    return m.knn(m.encode(e), asked(e), 10)


@query()
def learned_rotation(spark, sf):
    """VQ04, TRN05, TRN06."""
    e, m = _learned(spark, sf, preproc="rotate")
    return m.knn(m.encode(e), asked(e), 10)


@query()
def learned_block_rotation(spark, sf):
    """TRN08."""
    e, m = _learned(spark, sf, preproc="rotate_blocks")
    return m.knn(m.encode(e), asked(e), 10)


@query()
def learned_permutation_trees(spark, sf):
    """TRN09, MIT03, VQ21: permuted columns, hash-tree codes, averaged accumulation."""
    e, m = _learned(spark, sf, preproc="perm", encode="tree", quantize="half", accumulate="mean")
    return m.knn(m.encode(e), asked(e), 10)


@query()
def learned_splits(spark, sf):
    """MIT05-MIT07: single thresholds."""
    e, m = _learned(spark, sf, encode="splits", quantize="rint", accumulate="grouped", every=8)
    return m.knn(m.encode(e), asked(e), 10)
