"""Sources, sinks, windows, samples and relational steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.operators import metrics, results, sampling, windows
from prismframe.sources import readers, sinks


def test_npy_and_vecs(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(30, 5)).astype(np.float32)
    np.save(tmp_path / "a.npy", x)
    got = sorted(readers.read_npy(spark, str(tmp_path)).collect(), key=lambda r: r.vec_id)
    assert np.allclose([r.embedding for r in got], x) and [r.vec_id for r in got] == list(range(30))
    (tmp_path / "b.fvecs").write_bytes(b"".join(np.int32(5).tobytes() + r.tobytes() for r in x))
    assert np.allclose([r.embedding for r in sorted(readers.read_vecs(spark, str(tmp_path)).collect(), key=lambda r: r.vec_id)], x)
    (tmp_path / "c.bvecs").write_bytes(b"".join(np.int32(3).tobytes() + bytes([i, 2, 255]) for i in range(4)))
    assert [r.embedding[0] for r in sorted(readers.read_vecs(spark, str(tmp_path), "b").collect(), key=lambda r: r.vec_id)] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        readers.yael(np.int32(5).tobytes() + b"123", "f")
    assert {r.name for r in readers.list_files(spark, str(tmp_path), suffix="vecs").collect()} == {"b.fvecs", "c.bvecs"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n1 2.5\n\n-3 4e1\n")
    assert [r.embedding for r in readers.read_text_matrix(spark, str(tmp_path / "m.txt")).collect()] == [[1.0, 2.5], [-3.0, 40.0]]
    (tmp_path / "s.tsv").write_text("3\t1\tNaN\t2\n-1\t4\t5\t6\n")
    rows = readers.read_series(spark, str(tmp_path / "s.tsv"))
    assert {r.label: r.series for r in rows.collect()} == {3: [1.0, None, 2.0], -1: [4.0, 5.0, 6.0]}
    filled = {r.label: r.series for r in readers.fill_missing(rows, "series", "label").collect()}
    assert filled[3] == [1.0, 5.0, 2.0]
    assert {r.label: r.i for r in readers.reindex_labels(rows, "label", "i").collect()} == {-1: 0, 3: 1}
    (tmp_path / "d.csv").write_text("a,1\n--- junk, 3\nnothing\nb,2\n")
    assert [tuple(r) for r in readers.read_dirty_csv(spark, str(tmp_path / "d.csv"), "k string, v int").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "log").write_text("time: 1.5 ms, 2e3 rows\nno number here\nx: -4\n")
    got = {r.key: r.numbers for r in readers.read_key_values(spark, str(tmp_path / "log")).collect()}
    assert got == {"time": [1.5, 2000.0], "x": [-4.0]}
    lines = spark.createDataFrame([("a scan N, D, M, work:  100, 64, 8, 2   (5x20): 1.5 (4.2e+07/s), 2.5 (2e+3/s), ",), ("other",)], "value string")
    r = readers.parse_benchmark(lines).collect()
    assert [tuple(x) for x in r] == [("a scan", 100, 64, 8, "2", [1.5, 2.5], [4.2e7, 2000.0])]


def test_recording_and_meters(spark, tmp_path):
    x = np.random.default_rng(0).integers(-500, 500, (200, 3)).astype("<i2")
    (tmp_path / "r.dat").write_bytes(x.tobytes() + b"\x01")
    got = sorted(readers.read_recording(spark, str(tmp_path), 3, 20, "*.dat").collect(), key=lambda r: r.t)
    part = x[20:].astype(float)
    assert np.allclose([r["values"] for r in got], part - part.mean(0))
    (tmp_path / "m.csv").write_text("t,p\n60,1.5\n120,\n")
    rows = readers.read_meters(spark, str(tmp_path / "m.csv"), "t long, p double", "t").collect()
    assert [(r.ms, r.p) for r in rows] == [(60000, 1.5), (120000, None)]


def test_datasets_fall_back(spark, tmp_path):
    spark.range(50).withColumnRenamed("id", "vec_id").write.parquet(str(tmp_path / "t"))
    got = readers.load_dataset(spark, {"test": str(tmp_path / "t")}, 5)
    assert got["train"].count() == 50 and got["queries"].count() == 5 and got["truth"] is None


def test_appended_table(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.save_appended(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    got = sinks.save_appended(spark.createDataFrame([(2, "c", 5)], "k int, v string, extra int"), path, ["k"], ["k"])
    assert got.columns == ["extra", "k", "v"] and sorted((r.k, r.v, r.extra) for r in got.collect()) == [(1, "a", None), (2, "c", 5)]
    sinks.save_partitioned(got, str(tmp_path / "p"), ["k"])
    assert (tmp_path / "p" / "k=1").exists()
    made = []
    for _ in range(2):
        sinks.memoized(spark, str(tmp_path / "m"), lambda: made.append(1) or spark.range(3))
    assert made == [1]


def test_windows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0])], "i int, v array<double>")
    got = windows.stacked_windows(df, "i", "v", 2, 2).collect()
    assert [(r.i, r["at"], r.window) for r in got] == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]
    img = spark.createDataFrame([(1, [float(x) for x in range(12)])], "i int, v array<double>")
    p = img.select(windows.patches(F.col("v"), 3, 4, 1, (2, 2)).alias("p")).first().p
    assert len(p) == 6 and p[0] == [0.0, 1.0, 4.0, 5.0] and p[-1] == [6.0, 7.0, 10.0, 11.0]
    same = img.select(windows.patches(F.col("v"), 3, 4, 1, (3, 3), same=True).alias("p")).first().p
    assert len(same) == 12 and same[0][:4] == [0.0, 0.0, 0.0, 0.0]
    for size in (3, 5):
        gx, gy = windows.sobel(size)
        assert np.allclose(np.array(gx), -np.array(gx)[:, ::-1]) and np.allclose(gx, np.array(gy).T)
    assert abs(sum(windows.filter_bank("gaussian", 5)[0]) - 1) < 1e-12 and abs(sum(windows.filter_bank("dog", 5)[0])) < 1e-12


def test_autoregression(spark):
    rng = np.random.default_rng(0)
    v = [0.0, 0.0]
    for _ in range(2000):
        v.append(0.6 * v[-1] - 0.3 * v[-2] + rng.normal())
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "s int, t int, v double")
    got = windows.fit_autoregression(windows.lag_matrix(df, "s", ["t"], "v", 2).select("x", "y"), 2)
    assert np.allclose(got["weights"], [-0.3, 0.6], atol=0.06) and 0.2 < got["r2"] < 0.6
    assert windows.fit_autoregression(windows.lag_matrix(df.filter("t < 2"), "s", ["t"], "v", 2).select("x", "y"), 2)["n"] == 0


def test_resampling():
    t = np.arange(40) / 40
    x = np.stack([np.sin(2 * np.pi * 3 * t), np.cos(2 * np.pi * t) + 2])
    got = windows.resample(x, 60)
    s = np.arange(60) / 60
    assert np.allclose(got, [np.sin(2 * np.pi * 3 * s), np.cos(2 * np.pi * s) + 2]) and np.allclose(windows.resample(got, 40), x)


def test_sampling(spark):
    assert sampling.quotas({"a": 2, "b": 10, "c": 100}, 30) == {"a": 1, "b": 3, "c": 26}
    df = spark.createDataFrame([(i, i % 3 if i < 60 else 0) for i in range(100)], "i long, y int")
    got = sampling.balanced(df, "y", "i", 30).groupBy("y").count().collect()
    assert sum(r["count"] for r in got) == 30
    folds = sampling.k_folds(df, "y", "i", 4).groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in folds if r.y == 1) - min(r["count"] for r in folds if r.y == 1) <= 1
    assert sampling.grid({"m": ["a", "b"], "k": [1, 2]}, {"k": {"m": "a"}}) == [{"m": "a", "k": 1}, {"m": "a", "k": 2}, {"m": "b"}]


def test_relational(spark):
    times = spark.createDataFrame([(1, "x", 2.0, None), (2, "y", None, 4.0)], "i int, m string, a double, b double")
    got = {r.i: r for r in results.speedups(times.withColumn("time", F.lit(None).cast("double")), [], "m", "x", "time", ["a", "b"]).collect()}
    assert got[1].time == 2.0 and got[2].speedup == 0.5
    left = spark.createDataFrame([(1, 5.0), (2, 0.5)], "i int, t double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, 9.0)], "k int, v double")
    assert {r.i: r.v for r in results.at_or_below(left, right, ["k"], "t", "v", "i").collect()} == {1: 4.0, 2: 1.0}
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 3.0), (3, 2.0, 3.0), (4, 3.0, 5.0)], "i int, x double, y double")
    assert sorted(r.i for r in results.pareto(pts, "x", "y", "i").collect()) == [2, 4]


def test_packed_size(spark):
    rows = [(i, 0) for i in range(16)] + [(16 + i, 3) for i in range(8)] + [(24 + i, 0) for i in range(8)]
    df = spark.createDataFrame(rows, "t int, v long")
    size = lambda values, wide=True: metrics.packed_size(spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "t int, v long, w long"), F.col("t"), ["v", "w"], wide).first().bytes
    # a run of zero blocks costs one byte, a block of two bits 2 + 1, another run one
    assert metrics.packed_size(df, F.col("t"), ["v"]).first().bytes == 5
    # unsigned bits without a negative value: 3 for a 7, and a byte of header for two columns
    assert size([(7, 0)] * 8) == 4 and size([(7, 1)] * 8) == 5
    # with one, both columns are zigzag-coded: -1 is 2 and 7 is 13
    assert size([(7, -1)] * 8) == 1 + 4 + 2 and size([(-1, 0)] * 8) == 1 + 2
    # 7 bits count as 8 in 8-bit data, 15 as 16 in 16-bit data
    assert size([(100, 0)] * 8, False) == 1 + 8 and size([(20_000, 0)] * 8) == 1 + 16
