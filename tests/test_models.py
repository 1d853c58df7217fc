"""Learned models: statistical thresholds on a mixture, identities, storage, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.operators import amm, codebook, encoder, knn, linalg, lutquant, metrics, prototypes, tree
from prismframe.sources import synthetic


def mixture(n=2000, dim=64, centers=32, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dim)) * 8
    return c[rng.integers(0, centers, n)] + rng.normal(size=(n, dim))


@pytest.fixture(scope="module")
def data(spark):
    x = mixture()
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()


@pytest.mark.parametrize("reduction", ["l2", "dot"])
def test_encoder_correlation_and_precision(spark, data, reduction):
    x, df = data
    m = encoder.fit(df, encoder.by_accuracy(reduction, "low"))
    q = df.filter("vec_id >= 1980")
    scanned = m.transform(m.encode(df), q).cache()
    true = {(a, b): v for a in range(1980, 2000) for b, v in enumerate(((x - x[a]) ** 2).sum(1) if reduction == "l2" else x @ x[a])}
    rows = scanned.select("query_id", "id", "dist").collect()
    y, z = np.array([true[r.query_id, r.id] for r in rows]), np.array([r.dist for r in rows])
    assert np.corrcoef(y, z)[0, 1] > 0.95
    exact = knn.exact_knn(df, q, 10, "vec_id", "vec_id", metric=reduction)
    fine = encoder.fit(df, encoder.Spec(n_codebooks=64, reduction=reduction, quantize="none"))
    got = metrics.precision_at(fine.knn(fine.encode(df), q, 10), exact, 10).agg(F.avg("precision")).first()[0]
    assert got > 0.55


def test_fine_codes_unquantize(spark, data):
    x, df = data
    m = encoder.fit(df, encoder.by_accuracy("l2", "high"))
    rows = m.transform(m.encode(df), df.filter("vec_id < 5")).collect()
    y = np.array([((x[r.id] - x[r.query_id]) ** 2).sum() for r in rows])
    assert ((y - np.array([r.dist for r in rows])) ** 2).mean() / y.var() < 0.01


@pytest.mark.parametrize(
    "spec",
    [{"preproc": "rotate"}, {"preproc": "rotate_blocks"}, {"preproc": "perm"}, {"preproc": "corr_sample"}, {"encode": "tree"}, {"encode": "splits"}, {"quantize": "half", "accumulate": "mean"}, {"quantize": "rint"}, {"n_codebooks": 12}],
)
def test_every_kind_of_model_ranks(spark, data, spec):
    x, df = data
    m = encoder.fit_sample(x, encoder.Spec(**{"n_codebooks": 16, **spec}))
    got = m.knn(m.encode(df), df.filter("vec_id < 3"), 5).collect()
    assert len(got) == 15
    dist = {(r.query_id, r.id): ((x[r.query_id] - x[r.id]) ** 2).sum() for r in got}
    assert np.mean(list(dist.values())) < 0.3 * ((x[:200, None] - x[None, :200]) ** 2).sum(2).mean()


@pytest.mark.parametrize("spec", [{}, {"accumulate": "u8"}, {"reduction": "dot"}, {"quantize": "none"}, {"accumulate": "mean", "quantize": "half"}])
def test_search_is_the_ranked_scan(spark, data, spec):
    x, df = data
    m = encoder.fit_sample(x, encoder.Spec(**spec))
    codes, q = m.encode(df), df.filter("vec_id < 4")
    sign = 1 if m.spec.reduction == "l2" else -1
    want = {(r.query_id, r.id): (r.rank, r.dist) for r in knn.top_k(m.transform(codes, q), "query_id", [F.col("dist_q") * sign, F.col("id")], 7).collect()}
    got = {(r.query_id, r.id): (r.rank, r.dist) for r in m.knn(codes, q, 7).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in got)
    assert m.knn(codes, q.limit(0), 7).count() == 0 and m.knn(codes.filter("vec_id < 3"), q, 7).count() == 12


def test_save_and_load(spark, data, tmp_path):
    x, df = data
    m = encoder.fit_sample(x, encoder.Spec(encode="tree", preproc="perm"))
    m.save(spark, str(tmp_path / "m"))
    n = encoder.load(spark, str(tmp_path / "m"))
    assert (n.codes_of(x) == m.codes_of(x)).all() and np.allclose(n.luts_of(x[:5]), m.luts_of(x[:5])) and n.nbytes == 8


def test_more_codebooks_than_are_unrolled(spark, data):
    x, df = data
    m = encoder.fixed([np.array([[0.0], [8.0]])] * 64, encoder.Spec(n_codebooks=64, k=2, quantize="none"))
    wide = encoder.Model(m.spec, 64, m.mean, m.places, None, m.books)
    q, codes = df.filter("vec_id < 2"), m.encode(df)
    a = {(r.query_id, r.id): r.dist for r in wide.transform(codes, q).collect()}
    b = {(r.query_id, r.id): r.dist_q for r in m._scan_wide(codes, m.luts(q), "vec_id").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_shape_errors(spark, data):
    x, df = data
    with pytest.raises(ValueError):
        encoder.fit_sample(x[:, :8], encoder.Spec(n_codebooks=16))
    with pytest.raises(ValueError):
        encoder.fit_sample(x, encoder.Spec()).prepare(x[:, :10])
    with pytest.raises(amm.InvalidParameters):
        amm.RandGauss(64).fit(x, np.ones((64, 3)))


def test_knn_edges(spark, data):
    _, df = data
    few = df.filter("vec_id < 4")
    got = knn.exact_knn(few, few.filter("vec_id = 1"), 10, "vec_id", "vec_id").collect()
    assert len(got) == 4 and got[0].rank == 1
    assert knn.exact_knn(few, few.filter("vec_id < 0"), 3, "vec_id", "vec_id").count() == 0
    twins = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert sorted(r.id for r in knn.exact_knn(twins, twins.filter("vec_id = 5"), 3, "vec_id", "vec_id").collect()) == [0, 1, 2]


def test_degenerate_kmeans():
    x = np.vstack([np.zeros((5, 3)), [[1.0, 2, 3]] * 4])
    c, codes = codebook.kmeans(x, 4)
    assert (c[0] == [1, 2, 3]).all() and not c[1:].any() and codes[-1] == 0
    assert codebook.kmeans(mixture(300, 4), 4, init="subspaces")[0].shape == (4, 4)


def test_rotation_lowers_the_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8)) @ rng.normal(size=(8, 16)) + rng.normal(size=(1000, 16)) * 0.05
    from prismframe.functions.vector import even_spans

    spans = even_spans(16, 4)
    books, codes = codebook.learn(x, spans, 16)
    plain = ((codebook.decode(codes, books) - x) ** 2).mean()
    r, turned = codebook.learn_rotated(x, spans, 16, init="gauss")
    z = x @ r.T
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-8)
    assert ((codebook.decode(codebook.encode(z, turned, spans), turned) - z) ** 2).mean() < plain


def test_sketches_of_all_rows(spark):
    """By the factor of all rows' products a sketch has the error that it has by the rows themselves."""
    from prismframe.operators import amm, linalg

    rng = np.random.default_rng(8)
    x, b = rng.normal(size=(900, 24)) * np.linspace(3, 0.1, 24), rng.normal(size=(24, 20))
    x[7] *= 50  # a row that a sample may leave out
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    factor = linalg.gram_factor(df, "embedding")
    assert factor.shape == (24, 24) and np.allclose(factor.T @ factor, x.T @ x)
    for make in (amm.TopSquare, amm.SquareSample, amm.Pca, amm.Svd, amm.Cooccurrence):
        errors = [np.linalg.norm(make(8).fit(a, b).product(x) - x @ b) for a in (x, factor)]
        assert abs(errors[0] - errors[1]) < 1e-6 * np.linalg.norm(x @ b)
    assert np.linalg.norm(amm.FrequentDirections(8).fit(factor, b).product(x) - x @ b) < 0.3 * np.linalg.norm(x @ b)
    assert isinstance(amm.fitted(df, b, "pca", 8), amm.Pca)


def test_first_rotations():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    gauss = codebook.first_rotation(x, 4, "gauss")
    for init in ("identity", "random", "gauss", "gauss_shuffle", "gauss_flat"):
        r = codebook.first_rotation(x, 4, init, 1)
        assert np.allclose(r @ r.T, np.eye(12), atol=1e-9)
    shuffled = codebook.first_rotation(x, 4, "gauss_shuffle", 3).reshape(4, 3, 12)
    assert all(any(np.allclose(part, own) for own in gauss.reshape(4, 3, 12)) for part in shuffled) and not np.allclose(shuffled.reshape(12, 12), gauss)
    inside = gauss.T @ codebook.first_rotation(x, 4, "gauss_flat", 1)
    assert all(np.allclose(inside[a : a + 3, a : a + 3], inside[:3, :3]) for a in (3, 6, 9)) and np.allclose(inside[:3, 3:], 0)


def test_nearest_of_a_task_in_pieces():
    from prismframe.operators import knn

    rng = np.random.default_rng(5)
    dist = rng.integers(0, 300, (500, 7)).astype(float)
    found, limit = set(), None
    for lo in range(0, 500, 60):
        i, q, limit = knn.nearest(dist[lo : lo + 60], 5, limit)
        found |= {(lo + a, b) for a, b in zip(i.tolist(), q.tolist(), strict=True)}
    for q in range(7):
        fifth = np.sort(dist[:, q])[4]
        assert {(i, q) for i in np.flatnonzero(dist[:, q] <= fifth).tolist()} <= found
    assert len(found) < 500


def test_gram_identities(spark):
    rng = np.random.default_rng(0)
    codes, y, w = rng.integers(0, 16, (100, 8)), rng.normal(size=(100, 17)), rng.normal(size=(128, 17))
    hot = tree.gram_dense(codes, 16)
    df = spark.createDataFrame([(i, c.tolist(), v.tolist()) for i, (c, v) in enumerate(zip(codes, y, strict=True))], "i int, codes array<int>, y array<double>")
    xx, xy = np.zeros((128, 128)), np.zeros((128, 17))
    for r in tree.onehot_gram(df).collect():
        xx[r.c1 * 16 + r.k1, r.c2 * 16 + r.k2] = r.n
    for r in tree.onehot_xty(df, "codes", "y").collect():
        xy[r.c * 16 + r.k, r.m] = r.s
    assert (xx == hot.T @ hot).all() and np.allclose(xy, hot.T @ y)
    got = df.select("i", tree.onehot_lookup_sum(F.col("codes"), w[:, :3], 8, 16).alias("v")).collect()
    assert np.allclose([r.v for r in sorted(got, key=lambda r: r.i)], (hot @ w)[:, :3])
    spans = [(2 * c, 2 * c + 2) for c in range(8)]
    for how in ("eliminate", "pursuit", "backward"):
        s = tree.sparse_ridge(xx, xy[:, :16], 8, 16, spans, 4, how=how)
        assert (np.abs(s.reshape(8, 16, 16)).sum(1) > 0).sum(1).max() <= 4


def test_distributed_gram(spark, data):
    x, df = data
    xx, s, n = linalg.gram(df, "embedding", 64)
    assert n == 2000 and np.allclose(xx, x.T @ x) and np.allclose(s, x.sum(0))
    assert np.allclose(linalg.column_means(df, "embedding"), x.mean(0))
    perm = linalg.threshold_permutation(linalg.covariance(df, "embedding", 64), 8)
    assert sorted(perm) == list(range(64))


def test_products(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, (100, 80)).astype(float), rng.integers(0, 5, (80, 50)).astype(float)
    mean = np.concatenate([a.ravel(), b.ravel()]).mean()
    a, b = a - mean, b - mean
    true = a @ b

    def err(m):
        return ((m.fit(a, b).product(a) - true) ** 2).sum() / (true**2).sum()

    assert err(amm.Exact()) < 1e-20 and err(amm.ScalarQuantize()) < 1e-3
    svd = [err(amm.Svd(d)) for d in (1, 4, 16, 32)]
    assert all(x < 1 for x in svd) and svd == sorted(svd, reverse=True)
    fd = [err(amm.FrequentDirections(d)) for d in (1, 4, 16, 32)]
    assert all(x < 1.05 for x in fd) and fd[-1] < fd[0]
    assert err(amm.Cooccurrence(16)) < 1.05
    for name in amm.REGISTRY:
        m = amm.REGISTRY[name](16)
        assert np.isfinite(err(m)) and set(m.cost(100)) == {"muls", "lookups"}
    big = mixture(1000, 32, 8)
    w = rng.normal(size=(32, 4))
    t = big @ w
    for name in ("tree", "tree_float", "pq", "vq4"):
        m = amm.REGISTRY[name](8).fit(big, w)
        assert ((m.product(big) - t) ** 2).mean() / t.var() < 0.1, name


def test_square_sampling_is_unbiased():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 30)), rng.normal(size=(30, 5))
    got = np.mean([amm.SquareSample(10, seed).fit(a, b).product(a) for seed in range(400)], 0)
    assert np.abs(got - a @ b).mean() < 0.15 * np.abs(a @ b).mean()


def test_lut_quantisation():
    luts = np.random.default_rng(0).gamma(2, 3, (50, 8, 16))
    floors, scale, alpha = lutquant.grid(luts)
    q = lutquant.quantize(luts[0], floors, scale)
    assert 0 <= q.min() and q.max() <= 255 and alpha in lutquant.ALPHAS
    assert np.abs(q / scale + floors[:, None] - luts[0]).mean() < 0.2
    off, s = lutquant.power_of_two(luts)
    assert np.abs(lutquant.quantize_half(luts[0], off, s) / s + off[:, None] - luts[0]).max() <= 0.51 / s
    assert lutquant.grid(np.ones((3, 2, 4)))[1] == 1.0


def test_best_split_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 90).tolist(), rng.integers(0, 20, 90).tolist(), strict=True))] + [(9, 1.0, 100)]
    got = {r.node: (r.value, r.loss) for r in tree.best_splits(spark.createDataFrame(rows, "g long, x double, i long"), "g", "x").collect()}
    assert 9 not in got
    for g in range(3):
        x = np.sort([v for n, v, _ in rows if n == g])
        cuts = [((a + b) / 2) for a, b in zip(x, x[1:], strict=False) if b > a]
        loss = {c: sum(p.var() * len(p) for p in (x[x <= c], x[x > c])) for c in cuts}
        assert got[g][1] == pytest.approx(min(loss.values())) and loss[got[g][0]] == pytest.approx(min(loss.values()))


def test_prototypes_and_softmax():
    x = mixture(600, 16, 4, 5)
    y = codebook.kmeans(x, 4)[1]
    p, labels = prototypes.learn_prototypes(x, y, 2, gamma=0.1)
    assert (prototypes.vote(x, p, labels, 0.1) == y).mean() > 0.95
    w, pp, pl = prototypes.learn_projected_prototypes(x, y, 6, 2, gamma=0.1)
    assert (prototypes.vote(x @ w, pp, pl, 0.1) == y).mean() > 0.9
    assert ((x @ prototypes.learn_softmax(x, y)).argmax(1) == y).mean() > 0.9


def test_synthetic_is_the_same_on_any_split(spark):
    a = {r.vec_id: r.embedding for r in synthetic.vectors(spark, 50, 8, "walk").collect()}
    b = {r.vec_id: r.embedding for r in synthetic.vectors(spark, 50, 8, "walk").repartition(7).collect()}
    assert a == b and len(a[0]) == 8
    g = np.array([r.embedding for r in synthetic.vectors(spark, 3000, 8).collect()])
    assert abs(g.mean()) < 0.05 and abs(g.std() - 1) < 0.05


def test_streamed_codes(spark, data, tmp_path):
    from prismframe.streaming import encode as S

    x, df = data
    m = encoder.fit_sample(x, encoder.Spec())
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    S.write_codes(S.encode_stream(stream, m), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.vec_id: r.codes for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 2000 and got[7] == m.codes_of(x[7:8])[0].tolist()
    assert S.match_stream(stream, m, df.filter("vec_id = 0"), 1e9).isStreaming


def test_prototype_labels_learn_labels_that_begin_late(spark, tmp_path):
    """Labels come in runs of ids; the last begins after row 2000."""
    from prismframe.plans import products

    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2], [1100, 1100, 100])
    x = (rng.normal(size=(3, 64)) * 8)[y] + rng.normal(size=(len(y), 64))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in products.prototype_labels(spark, str(tmp_path)).collect()}
    for how in ("by_vote", "by_projection", "by_softmax"):
        assert np.mean([got[i][how] == 2 for i in range(2200, 2300)]) >= 0.9
