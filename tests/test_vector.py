"""Column builders against hand-made fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators import codebook


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def arr(xs):
    return F.array(*map(F.lit, xs))


def test_distances(spark):
    a, b = arr([1.0, 2.0, 3.0]), arr([2.0, 0.0, 3.5])
    r = one(spark, dot=V.dot(a, b), l2=V.l2(a, b), l1=V.l1(a, b), h=V.hamming(a, b), cos=V.cosine(a, b), zero=V.cosine(a, arr([0.0] * 3)))
    assert (r.dot, r.l2, r.l1, r.h, r.zero) == (12.5, 5.25, 3.5, 3, None)
    assert r.cos == pytest.approx(12.5 / np.sqrt(14 * 16.25))


def test_bit_costs_and_zigzag(spark):
    signed = {0: 0, 1: 2, 2: 3, 3: 3, 4: 4, 5: 4, 7: 4, 8: 5, 9: 5, -1: 1, -2: 2, -3: 3, -4: 3, -5: 4, -7: 4, -8: 4, -9: 5}
    rows = spark.createDataFrame([(k,) for k in signed], "x long")
    got = rows.select("x", V.nbits_signed(F.col("x")).alias("b"), V.zigzag(F.col("x")).alias("z")).withColumn("back", V.unzigzag(F.col("z"))).collect()
    assert {r.x: r.b for r in got} == signed
    assert all(r.back == r.x for r in got)
    assert {r.x: r.z for r in got if abs(r.x) < 4} == {0: 0, 1: 1, -1: 2, 2: 3, -2: 4, 3: 5, -3: 6}
    u = spark.createDataFrame([(k,) for k in (0, 2, 1, 3, 4)], "x long").select(V.nbits_unsigned(F.col("x")).alias("b")).collect()
    assert [r.b for r in u] == [0, 2, 1, 2, 3]


def test_packing_round_trip(spark):
    codes = [3, 15, 0, 7, 8, 1]
    r = one(spark, p=V.pack_nibbles(arr(codes), 6), u=V.unpack_nibbles(V.pack_nibbles(arr(codes), 6), 6), l=V.pack_long(arr(codes), 6))
    assert (r.p, r.u, r.l) == ([243, 112, 24], codes, sum(c << 4 * i for i, c in enumerate(codes)))


def test_popcount_is_the_sum_of_nibble_tables(spark):
    rows = [(i, [2 * j + ((i % 16) << 4) for j in range(8)]) for i in range(96)]
    q = [2 * j + (((2 * j + 1) % 16) << 4) for j in range(8)]
    got = spark.createDataFrame(rows, "i int, b array<long>").select("i", V.hamming_bits(F.col("b"), arr([*map(np.int64, q)])).alias("n")).collect()
    table = [bin(x).count("1") for x in range(16)]
    for r in got:
        assert r.n == sum(table[(x ^ y) & 15] + table[(x ^ y) >> 4] for x, y in zip(rows[r.i][1], q, strict=True))


@pytest.mark.parametrize("m", [1, 2, 4])
def test_given_codebook_codes_and_tables(m):
    """Centroids, vectors and queries on a grid, for which codes and tables are known."""
    c = 2 * m
    books = [np.array([[k + 16 * b + j for j in range(3)] for k in range(16)], float) for b in range(c)]
    spans = V.even_spans(3 * c, c)
    x = np.array([[16 * b + j + b + i % 5 for b in range(c) for j in range(3)] for i in range(10)], float)
    assert (codebook.encode(x, books, spans) == [[b + i % 5 for b in range(c)] for i in range(10)]).all()
    assert (codebook.encode(x, books, spans, rounded=True) == codebook.encode(x, books, spans)).all()
    one_x = np.array([[16 * b + j + 2 * b for b in range(c) for j in range(3)]], float)
    assert codebook.encode(one_x, books, spans).tolist() == [[2 * b for b in range(c)]]


def test_scans(spark):
    rng = np.random.default_rng(0)
    codes, lut = rng.integers(0, 16, (32, 16)), rng.integers(0, 60, 256)
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "i int, codes array<int>").withColumn("lut", arr(lut.tolist()))
    n, c, t = 16, F.col("codes"), F.col("lut")
    got = df.select("i", V.lut_sum(c, t, n).alias("s"), V.lut_sum_u8(c, t, n).alias("u"), V.lut_sum_pairs(c, t, n).alias("p"), V.lut_mean(c, t, n).alias("m"), V.lut_sum_grouped(c, t, n, every=4, top=100).alias("g")).collect()
    for r in got:
        v = lut.reshape(16, 16)[np.arange(16), codes[r.i]]
        assert r.s == v.sum() and r.u == min(255, v.sum()) and r.p == sum(min(255, v[j] + v[j + 1]) for j in range(0, 16, 2))
        assert r.g == sum(min(100, v[j : j + 4].sum()) for j in range(0, 16, 4))
        w = v
        while len(w) > 1:
            w = (w[::2] + w[1::2] + 1) // 2
        assert r.m == w[0] * 16 - 16


def test_tree_and_split_codes(spark):
    levels = [{"dim": 0, "vals": [0.0]}, {"dim": 1, "vals": [0.5, -0.5]}, {"dim": 2, "vals": [0, 1, 2, 3], "offset": 1.0, "scale": 2.0}]
    from prismframe.operators.tree import tree_codes

    x = np.random.default_rng(1).normal(size=(50, 3)) * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = {r.i: (r.g, r.s) for r in df.select("i", V.tree_code(F.col("v"), levels).alias("g"), V.split_code(F.col("v"), [(0, 0.0), (2, 1.0)]).alias("s")).collect()}
    want = tree_codes(x, levels)
    assert all(got[i] == (want[i], int(x[i, 0] > 0) + 2 * int(x[i, 2] > 1)) for i in range(50))


def test_padding_and_spans():
    for d in range(1, 30):
        for m in range(1, 12):
            places = V.padded(d, m)
            assert len(places) % m == 0 and [p for p in places if p >= 0] == list(range(d))
    assert V.padded(64, 72).count(-1) == 8
    assert V.even_spans(7, 3) == [(0, 3), (3, 5), (5, 7)] and V.even_spans(7, 3, False) == [(0, 2), (2, 4), (4, 7)]
    assert V.inverse_permutation([2, 0, 1]) == [1, 2, 0]


def test_normalize_of_zero_and_null(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<double>")
    got = [r.n for r in df.select(V.normalize(F.col("v")).alias("n")).collect()]
    assert got == [[None, None], [0.6, 0.8], None]
