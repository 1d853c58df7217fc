"""Queries: hash trees, one-hot products, matrix products and their quality (MIT, AMM, MET01)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators import amm, linalg, prototypes, tree
from prismframe.operators.arrow import sample
from prismframe.plans.base import CENTROIDS, CODEBOOKS, CODES, FLAT, asked, cells, embeddings, query
from prismframe.plans.search import _given

#: A given tree for each of 16 codebooks: four levels on the codebook's own components, thresholds by rule.
TREES = [[{"dim": 4 * c + s, "vals": [(g - (2**s - 1) / 2) / 40 for g in range(2**s)]} for s in range(4)] for c in range(CODEBOOKS)]
TREE_SQL = """vecs AS (SELECT vec_id, list(x ORDER BY pos) AS v FROM flat GROUP BY vec_id),
g1 AS (SELECT vec_id, v, c::INT AS c, CASE WHEN v[4 * c + 1] > 0 THEN 1 ELSE 0 END AS g FROM vecs, range(16) t(c)),
g2 AS (SELECT vec_id, v, c, 2 * g + CASE WHEN v[4 * c + 2] > (g - 0.5::DOUBLE) / 40 THEN 1 ELSE 0 END AS g FROM g1),
g3 AS (SELECT vec_id, v, c, 2 * g + CASE WHEN v[4 * c + 3] > (g - 1.5::DOUBLE) / 40 THEN 1 ELSE 0 END AS g FROM g2),
leaf AS (SELECT vec_id, c, 2 * g + CASE WHEN v[4 * c + 4] > (g - 3.5::DOUBLE) / 40 THEN 1 ELSE 0 END AS code FROM g3)"""


@query(f"WITH {FLAT}, {TREE_SQL} SELECT vec_id, c AS codebook, code::INT AS code FROM leaf")
def tree_encode_fixed(spark, sf):
    """MIT08, MIT09: four comparisons a codebook, all in the JVM."""
    codes = F.array(*(V.tree_code(F.col("embedding"), t) for t in TREES))
    return embeddings(spark, sf).select("vec_id", F.posexplode(codes).alias("codebook", "code"))


@query(f"WITH {FLAT} SELECT vec_id, pos // 8 AS codebook, sum(CASE WHEN x > 0.01 * (pos % 8 - 4) THEN 1 << (pos % 8)::INT ELSE 0 END)::INT AS code FROM flat GROUP BY ALL")
def split_encode_fixed(spark, sf):
    """MIT07: eight thresholds a codebook."""
    codes = F.array(*(V.split_code(F.col("embedding"), [(8 * c + i, 0.01 * (i - 4)) for i in range(8)]) for c in range(8)))
    return embeddings(spark, sf).select("vec_id", F.posexplode(codes).alias("codebook", "code")).withColumn("codebook", F.col("codebook").cast("long"))


@query(f"""WITH {FLAT} SELECT label AS node, pos::INT AS pos, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sum2, round(sum(x * x) - sum(x) * sum(x) / count(*), 6) AS loss
FROM flat GROUP BY label, pos""")
def bucket_stats(spark, sf):
    """MIT01."""
    got = tree.bucket_stats(embeddings(spark, sf), "label", "embedding")
    return got.select("node", "pos", "n", *(F.round(c, 6).alias(c) for c in ("sum", "sum2", "loss")))


@query("""WITH w AS (
  SELECT l_suppkey AS node, l_quantity AS x,
    count(*) OVER u AS n, sum(l_quantity) OVER u AS s, sum(l_quantity * l_quantity) OVER u AS s2,
    count(*) OVER a AS all_n, sum(l_quantity) OVER a AS all_s, sum(l_quantity * l_quantity) OVER a AS all_s2,
    lead(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey * 10 + l_linenumber) AS next
  FROM lineitem
  WINDOW u AS (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY l_suppkey)
), c AS (SELECT node, (x + next) / 2 AS value, round(s2 - s * s / n + all_s2 - s2 - (all_s - s) * (all_s - s) / (all_n - n), 9) AS loss FROM w WHERE next > x)
SELECT node, arg_min(value, (loss, value)) AS value, round(min(loss), 6) AS loss FROM c GROUP BY node""")
def optimal_split(spark, sf):
    """MIT02: the best cut of quantities, supplier by supplier."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_quantity")
    return tree.best_splits(t, "l_suppkey", "l_quantity").withColumn("loss", F.round("loss", 6))


@query(f"""WITH {CODES} SELECT a.c::INT AS c1, a.code::INT AS k1, b.c::INT AS c2, b.code::INT AS k2, count(*) AS n FROM codes a JOIN codes b USING (vec_id) GROUP BY ALL""")
def onehot_gram(spark, sf):
    """MIT14: X'X of one-hot codes."""
    e, m = _given(spark, sf)
    return tree.onehot_gram(m.encode(e).select("vec_id", F.col("codes").cast("array<int>").alias("codes")))


@query(f"""WITH {CODES} SELECT codes.c::INT AS c, code::INT AS k, pos::INT AS m, round(sum(x), 6) AS s FROM codes JOIN flat USING (vec_id) GROUP BY codes.c, code, pos""")
def onehot_xty(spark, sf):
    """MIT14: X'Y."""
    e, m = _given(spark, sf)
    got = tree.onehot_xty(m.encode(e).join(e, "vec_id"), "codes", "embedding")
    return got.select("c", F.col("k").cast("int").alias("k"), "m", F.round("s", 6).alias("s"))


@query(f"""WITH {CODES} SELECT vec_id, m::INT AS pos, round(sum(((c * 16 + code) * 7 + m * 3) % 11 - 5)::DOUBLE, 6) AS x FROM codes, range(5) t(m) GROUP BY vec_id, m""")
def onehot_lookup_sum(spark, sf):
    """MIT14: XW."""
    e, m = _given(spark, sf)
    w = np.array([[(r * 7 + j * 3) % 11 - 5 for j in range(5)] for r in range(CODEBOOKS * CENTROIDS)], float)
    return cells(m.encode(e).select("vec_id", tree.onehot_lookup_sum(F.col("codes"), w, CODEBOOKS, CENTROIDS).alias("v")), "vec_id", "v")


# ---------------------------------------------------------------- products with a given 64 x 8 matrix


def given_matrix(rows: int = 64, cols: int = 8) -> np.ndarray:
    return np.array([[((i * 7 + j * 13) % 17 - 8) / 8 for j in range(cols)] for i in range(rows)])


B = "((pos * 7 + m * 13) % 17 - 8) / 8.0::DOUBLE"


@query(f"WITH {FLAT} SELECT vec_id, m::INT AS pos, round(sum(x * {B}), 6) AS x FROM flat, range(8) t(m) GROUP BY vec_id, m")
def matmul_exact(spark, sf):
    """AMM01, AMM30."""
    return cells(amm.Exact().fit(np.zeros((0, 64)), given_matrix()).apply(embeddings(spark, sf)), "vec_id", "product")


@query(f"WITH {FLAT} SELECT vec_id, m::INT AS pos, round(sum(x * {B}), 6) AS x FROM flat, range(8) t(m) GROUP BY vec_id, m")
def matmul_columns(spark, sf):
    """AMM01 without Python: one unrolled product a column."""
    b = given_matrix()
    return cells(embeddings(spark, sf).select("vec_id", F.array(*(V.dot_fixed(F.col("embedding"), b[:, j]) for j in range(8))).alias("v")), "vec_id", "v")


@query(f"WITH {FLAT} SELECT vec_id AS i, m AS k, round(sum(x * {B}), 6) AS z FROM flat, range(8) t(m) GROUP BY vec_id, m")
def matmul_coordinates(spark, sf):
    """AMM01 with both sides distributed."""
    a = embeddings(spark, sf).select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("x"))
    b = spark.range(64).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    b = b.withColumn("y", ((F.col("j") * 7 + F.col("k") * 13) % 17 - 8) / 8)
    return amm.multiply_coordinates(a, b).withColumn("z", F.round("z", 6))


@query(f"""WITH {FLAT}, s AS (SELECT vec_id, min(x) AS lo, 255 / (max(x) - min(x)) AS sc FROM flat GROUP BY vec_id), qa AS (SELECT vec_id, pos, lo, sc, floor((x - lo) * sc) AS q FROM flat JOIN s USING (vec_id)),
b AS (SELECT pos, m, {B} AS y FROM (SELECT DISTINCT pos FROM flat), range(8) t(m)), sb AS (SELECT m, min(y) AS lo, 255 / (max(y) - min(y)) AS sc FROM b GROUP BY m),
qb AS (SELECT pos, m, lo + 128 / sc AS lo, sc, floor((y - lo) * sc) - 128 AS q FROM b JOIN sb USING (m))
SELECT vec_id, m::INT AS pos, round(sum((qa.q / qa.sc + qa.lo) * (qb.q / qb.sc + qb.lo)), 2) AS x FROM qa JOIN qb USING (pos) GROUP BY vec_id, m""")
def matmul_scalarq(spark, sf):
    """AMM02; two digits, as a value on the border of two levels may fall to either side."""
    return cells(amm.ScalarQuantize().fit(np.zeros((0, 64)), given_matrix()).apply(embeddings(spark, sf)), "vec_id", "product", 2)


@query(f"""WITH {FLAT}, h AS (SELECT i::INT AS i, j, CASE WHEN bit_count(i::INT & j::INT) % 2 = 0 THEN 1 ELSE -1 END / sqrt(16) AS h FROM range(64) t(i), range(16) u(j)),
a AS (SELECT vec_id, j, sum(x * h) AS s FROM flat JOIN h ON h.i = pos GROUP BY vec_id, j), b AS (SELECT j, m, sum(h * ((i * 7 + m * 13) % 17 - 8) / 8.0::DOUBLE) AS s FROM h, range(8) t(m) GROUP BY j, m)
SELECT vec_id, m::INT AS pos, round(sum(a.s * b.s), 6) AS x FROM a JOIN b USING (j) GROUP BY vec_id, m""")
def matmul_hadamard(spark, sf):
    """AMM07."""
    return cells(amm.Hadamard(16).fit(np.zeros((0, 64)), given_matrix()).apply(embeddings(spark, sf)), "vec_id", "product")


def _columns(spark, b: np.ndarray):
    """A matrix's columns as query vectors."""
    return spark.createDataFrame([(j, [float(x) for x in b[:, j]]) for j in range(b.shape[1])], "vec_id int, embedding array<double>")


def _sketch_sql(make) -> str:
    """The product by a sketch, whose matrix the SQL holds as a table; sketches of these kinds don't look at the data."""
    v = make(16).fit(np.zeros((0, 64)), given_matrix()).v
    cells_ = ", ".join(f"({i},{j},{v[i, j]!r}::DOUBLE)" for i, j in zip(*(x.tolist() for x in np.nonzero(v)), strict=True)).replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE")
    return f"""WITH {FLAT}, s(i, j, g) AS (VALUES {cells_}),
a AS (SELECT vec_id, j, sum(x * g) AS s FROM flat JOIN s ON s.i = pos GROUP BY vec_id, j), b AS (SELECT j, m, sum(g * ((i * 7 + m * 13) % 17 - 8) / 8.0::DOUBLE) AS s FROM s, range(8) t(m) GROUP BY j, m)
SELECT vec_id, m::INT AS pos, round(sum(a.s * b.s), 5) AS x FROM a JOIN b USING (j) GROUP BY vec_id, m"""


def _sketched(spark, sf, make):
    return cells(make(16).fit(np.zeros((0, 64)), given_matrix()).apply(embeddings(spark, sf)), "vec_id", "product", 5)


@query(_sketch_sql(amm.RandGauss))
def matmul_gauss(spark, sf):
    """AMM03, AMM04."""
    return _sketched(spark, sf, amm.RandGauss)


@query(_sketch_sql(amm.OrthoGauss))
def matmul_orthogonal(spark, sf):
    """AMM05."""
    return _sketched(spark, sf, amm.OrthoGauss)


@query(_sketch_sql(amm.Rademacher))
def matmul_signs(spark, sf):
    """AMM06."""
    return _sketched(spark, sf, amm.Rademacher)


@query(_sketch_sql(amm.FastJL))
def matmul_fast_jl(spark, sf):
    """AMM13."""
    return _sketched(spark, sf, amm.FastJL)


@query(_sketch_sql(amm.HashJL))
def matmul_hash(spark, sf):
    """AMM14."""
    return _sketched(spark, sf, amm.HashJL)


@query(_sketch_sql(amm.Osnap))
def matmul_osnap(spark, sf):
    """AMM15: four hash sketches on ranges of columns."""
    return _sketched(spark, sf, amm.Osnap)


@query(f"""WITH {FLAT}, b AS (SELECT pos, m, {B} AS y FROM (SELECT DISTINCT pos FROM flat), range(8) t(m)),
w AS (SELECT pos, sqrt(sum(x * x)) AS w FROM flat GROUP BY pos), r AS (SELECT pos, sqrt(sum(y * y)) AS r FROM b GROUP BY pos), top AS (SELECT pos FROM w JOIN r USING (pos) ORDER BY w * r DESC, pos LIMIT 16)
SELECT vec_id, m::INT AS pos, round(sum(x * y), 6) AS x FROM flat JOIN top USING (pos) JOIN b USING (pos) GROUP BY vec_id, m""")
def matmul_top_square(spark, sf):
    """AMM09: the sixteen dimensions of the largest products of norms, over all rows; that many dimensions are the feature."""
    e = embeddings(spark, sf)
    return cells(amm.TopSquare(16).fit(linalg.gram_factor(e, "embedding"), given_matrix()).apply(e), "vec_id", "product")


#: Offsets and a scale for the trees above, so that components become whole numbers of one byte.
TREE_SCALE = 128.0


@query(f"""WITH {FLAT}, flat8 AS (SELECT vec_id, pos, greatest(-128, least(127, floor(x * 128 + 0.5))) AS x FROM flat), {TREE_SQL.replace("FROM flat GROUP BY", "FROM flat8 GROUP BY")
    .replace("(g - 0.5::DOUBLE) / 40", "floor((g - 0.5::DOUBLE) / 40 * 128 + 0.5)").replace("(g - 1.5::DOUBLE) / 40", "floor((g - 1.5::DOUBLE) / 40 * 128 + 0.5)").replace("(g - 3.5::DOUBLE) / 40", "floor((g - 3.5::DOUBLE) / 40 * 128 + 0.5)")}
SELECT vec_id, c AS codebook, code::INT AS code FROM leaf""")
def tree_encode_bytes(spark, sf):
    """MIT10, MIT11: components and thresholds as signed bytes, compared as whole numbers."""
    small = F.transform("embedding", lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * TREE_SCALE + 0.5))).cast("int"))
    trees = [[{"dim": s["dim"], "vals": [float(np.floor(v * TREE_SCALE + 0.5)) for v in s["vals"]]} for s in t] for t in TREES]
    rows = embeddings(spark, sf).select("vec_id", small.alias("small"))
    return rows.select("vec_id", F.posexplode(F.array(*(V.tree_code(F.col("small"), t) for t in trees))).alias("codebook", "code"))


@query(f"""WITH {FLAT}, {TREE_SQL}, t AS (SELECT c, k, m, sum(((((c * 16 + k) * 64 + i) * 7) % 23 - 11) * ((i * 7 + m * 13) % 17 - 8) / 8.0::DOUBLE) AS t FROM range(16) a(c), range(16) b(k), range(64) d(i), range(8) u(m) GROUP BY c, k, m)
SELECT vec_id, m::INT AS pos, round(sum(t), 6) AS x FROM leaf JOIN t ON t.c = leaf.c AND t.k = leaf.code GROUP BY vec_id, m""")
def tree_full_width_tables(spark, sf):
    """MIT16: tables of centroids that span all components, added up by tree codes."""
    centroids = np.array([[(r * 64 + i) * 7 % 23 - 11 for i in range(64)] for r in range(16 * 16)], float)
    e = embeddings(spark, sf).select("vec_id", F.array(*(V.tree_code(F.col("embedding"), t) for t in TREES)).alias("codes"))
    return cells(e.select("vec_id", tree.onehot_lookup_sum(F.col("codes"), centroids @ given_matrix(), 16, 16).alias("v")), "vec_id", "v")


class FixedHash(amm.Sketch):
    """A hash sketch by arithmetic."""

    def matrix(self, a, b, rng):
        v = np.zeros((len(b), self.d))
        for i in range(len(b)):
            v[i, (i * 7 + 3) % self.d] = 1 if (i * 5 + 1) % 3 else -1
        return v


@query(f"""WITH {FLAT}, h AS (SELECT i, (i * 7 + 3) % 16 AS j, CASE WHEN (i * 5 + 1) % 3 <> 0 THEN 1 ELSE -1 END AS g FROM range(64) t(i)),
a AS (SELECT vec_id, j, sum(x * g) AS s FROM flat JOIN h ON h.i = pos GROUP BY vec_id, j), b AS (SELECT j, m, sum(g * ((i * 7 + m * 13) % 17 - 8) / 8.0::DOUBLE) AS s FROM h, range(8) t(m) GROUP BY j, m)
SELECT vec_id, m::INT AS pos, round(sum(a.s * b.s), 6) AS x FROM a JOIN b USING (j) GROUP BY vec_id, m""")
def matmul_countsketch_fixedhash(spark, sf):
    """AMM03 with a hash by arithmetic."""
    return cells(FixedHash(16).fit(np.zeros((0, 64)), given_matrix()).apply(embeddings(spark, sf)), "vec_id", "product")


@query(f"""WITH {CODES}, t AS (SELECT c, k, m, sum(y * {B}) AS t FROM cent, range(8) u(m) GROUP BY c, k, m)
SELECT vec_id, m::INT AS pos, round(sum(t) + 1e-9, 6) AS x FROM codes JOIN t ON t.c = codes.c AND t.k = codes.code GROUP BY vec_id, m""")
def matmul_pq(spark, sf):
    """AMM20 with the given codebook: the matrix's columns are queries, their tables are made once.

    Entries are multiples of 1e-6 / 8, so sums lie on the border of two roundings now and then: a little is added on both sides.
    """
    e, m = _given(spark, sf, reduction="dot")
    got = m.transform(m.encode(e), _columns(spark, given_matrix()))
    return got.select(F.col("id").alias("vec_id"), F.col("query_id").alias("pos"), F.round(F.col("dist") + 1e-9, 6).alias("x"))


@query(f"""WITH {CODES}, t AS (SELECT c, k, m, sum(y * {B}) AS t FROM cent, range(8) u(m) GROUP BY c, k, m),
p AS (SELECT vec_id, m, sum(t) AS yh FROM codes JOIN t ON t.c = codes.c AND t.k = codes.code GROUP BY vec_id, m),
e AS (SELECT vec_id, m, sum(x * {B}) AS y FROM flat, range(8) t(m) GROUP BY vec_id, m), b AS (SELECT * FROM p JOIN e USING (vec_id, m))
SELECT round(avg(power(y - yh, 2)), 6) AS raw_mse, round(avg(power(y - yh, 2)) / var_pop(y), 6) AS normalized_mse, round(corr(y, yh), 6) AS corr,
  round(sum(y * yh) / sqrt(sum(y * y) * sum(yh * yh)), 6) AS cossim, round(avg(y), 6) AS y_mean, round(stddev_pop(y), 6) AS y_std, round(avg(yh), 6) AS yhat_mean, round(stddev_pop(yh), 6) AS yhat_std FROM b""")
def matmul_metrics(spark, sf):
    """MET01, DST09, DST10."""
    e, m = _given(spark, sf, reduction="dot")
    got = m.transform(m.encode(e), _columns(spark, given_matrix()))
    approx = got.groupBy(F.col("id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "dist"))), lambda s: s["dist"]).alias("product"))
    got = amm.metrics(approx, amm.Exact().fit(np.zeros((0, 64)), given_matrix()).apply(e))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query()
def amm_methods(spark, sf):
    """AMM01-AMM18, AMM20-AMM29, UDF02: every registered method on the embeddings with a random matrix: quality and cost, a row a method."""
    e = embeddings(spark, sf)
    b = np.random.default_rng(0).normal(size=(64, 20))
    a, factor = sample(e, "embedding", 2000, "vec_id"), linalg.gram_factor(e, "embedding")  # codes are learned on a sample, sketches on the products of all rows
    exact = amm.Exact().fit(a, b).apply(e)
    n = e.count()
    out = None
    for name, make in amm.REGISTRY.items():
        method = make(16)
        method.fit(factor if isinstance(method, amm.Sketch) else a, b)
        cost = method.cost(n)
        row = amm.metrics(method.apply(e), exact).withColumns({"method": F.lit(name), "muls": F.lit(cost["muls"]).cast("long"), "lookups": F.lit(cost["lookups"]).cast("long")})
        out = row if out is None else out.union(row)
    return out


@query()
def tree_product(spark, sf):
    """MIT12-MIT20: trees, ridge-refitted centroids, joint power-of-two tables, all scans as compiled lookups."""
    e = embeddings(spark, sf)
    b = np.random.default_rng(0).normal(size=(64, 8))
    m = amm.TreeProduct(16).fit(sample(e, "embedding", 4000, "vec_id"), b)
    codes = e.select("vec_id", m.model.codes(F.col("embedding")).alias("codes"))
    tables = spark.createDataFrame([(j, [int(x) for x in t.ravel()]) for j, t in enumerate(m.table)], "output int, lut array<int>")
    rows = codes.crossJoin(F.broadcast(tables))  # a row a column of the matrix
    return rows.select("vec_id", "output", (V.lut_sum(F.col("codes"), F.col("lut"), 16) / float(m.scale) + float(m.offsets.sum())).alias("product"))


@query()
def learned_tree_codes(spark, sf):
    """MIT03, MIT06, MIT09: a tree learned on a sample, codes for all rows."""
    e = embeddings(spark, sf)
    x = sample(e, "embedding", 4000, "vec_id")
    trees = [tree.learn_tree(x, 4, 4, range(4 * c, 4 * c + 4), quantized=True) for c in range(16)]
    return e.select("vec_id", F.posexplode(F.array(*(V.tree_code(F.col("embedding"), t) for t in trees))).alias("codebook", "code"))


@query()
def prototype_labels(spark, sf, per_label=400):
    """CLS01-CLS05: labels by learned prototypes, projected prototypes and softmax weights.

    Learned from at most ``per_label`` rows of each label, those with the smallest hash of their id, so that every label is learned.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from prismframe.operators.arrow import map_rows, sample_by_label

    x, y = sample_by_label(embeddings(spark, sf), "embedding", "label", per_label, "vec_id")
    p, labels = prototypes.learn_prototypes(x, y, 2)
    w, pp, plabels = prototypes.learn_projected_prototypes(x, y, 8, 2)
    soft, classes = prototypes.learn_softmax(x, y), np.unique(y)
    out = [(c, T.IntegerType(), pa.int32()) for c in ("by_vote", "by_projection", "by_softmax")]
    return map_rows(embeddings(spark, sf), "embedding", ["vec_id"], out, lambda v: [prototypes.vote(v, p, labels), prototypes.vote(v @ w, pp, plabels), classes[(v @ soft).argmax(1)]])
