"""Compressed vectors: train, encode, look up, scan, and search on codes (VQ01-VQ19, VQ21, SNK05)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.functions import vector as V
from prismframe.operators import codebook, knn, linalg, lutquant, tree
from prismframe.operators.arrow import lists, map_rows, sample

#: Bytes of a code by name.
ACCURACY = {"lowest": 2, "low": 8, "medium": 16, "high": 32}
#: A scan is unrolled into compiled lookups up to so many codebooks; beyond, NumPy looks up in Arrow batches.
#: Distances that a task holds at a time in a search.
SCAN_CELLS = 1 << 20
MOST_UNROLLED = 64


@dataclass(frozen=True)
class Spec:
    n_codebooks: int = 16
    k: int = 16
    reduction: str = "l2"  #: l2 or dot
    preproc: str = "none"  #: none, rotate, rotate_blocks, perm, perm_sample, corr, corr_sample
    encode: str = "kmeans"  #: kmeans, tree (hash trees) or splits (single thresholds)
    quantize: str = "floor"  #: of the lookup tables: none, floor, rint (both by the percentile grid) or half (joint power of two)
    accumulate: str = "sum"  #: sum, u8, pairs, grouped or mean
    every: int = 16
    center: bool | None = None  #: None: for l2 only
    sample: int = 20_000  #: vectors that are trained on, at most
    train_queries: int = 1000
    block: int = 16
    seed: int = 0

    @property
    def centered(self) -> bool:
        return self.reduction == "l2" if self.center is None else self.center


def by_accuracy(reduction: str = "l2", accuracy: str = "medium") -> Spec:
    """VQ19: two 4-bit codes a byte; tables are rounded to the nearest integer, so that sums have no bias when they are taken back."""
    return Spec(n_codebooks=2 * ACCURACY[accuracy], reduction=reduction, quantize="rint")


@dataclass
class Model:
    """What training leaves: a few hundred KB, sent to every task."""

    spec: Spec
    dim: int
    mean: np.ndarray
    places: list[int]
    rotation: np.ndarray | None
    books: list[np.ndarray]
    trees: list[list[dict]] = field(default_factory=list)
    offsets: np.ndarray | None = None
    scale: float = 1.0

    @property
    def width(self) -> int:
        return len(self.places)

    @property
    def spans(self) -> list[tuple[int, int]]:
        return V.even_spans(self.width, self.spec.n_codebooks)

    @property
    def nbytes(self) -> float:
        """MET11: bytes of a row's code."""
        return self.spec.n_codebooks * max(1, int(np.ceil(np.log2(self.spec.k)))) / 8

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """Centred, padded or permuted, rotated."""
        if x.shape[1] != self.dim:
            raise ValueError(f"vectors of {x.shape[1]} components; the model has {self.dim}")
        x = np.hstack([x - self.mean, np.zeros((len(x), 1))])[:, self.places]
        return x if self.rotation is None else x @ self.rotation.T

    # ------------------------------------------------ codes and tables

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        z = self.prepare(x)
        if self.spec.encode == "kmeans":
            return codebook.encode(z, self.books, self.spans)
        return np.stack([tree.tree_codes(z, t) for t in self.trees], 1)

    def encode(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """VQ01-VQ04: (id, codes). Narrow: no shuffle, one pass."""
        return map_rows(df, vector, [id_col], [("codes", T.ArrayType(T.ShortType()), pa.int16())], lambda x: [self.codes_of(x)])

    def raw_luts(self, q: np.ndarray) -> np.ndarray:
        """VQ12, VQ16: (queries, codebooks, k)."""
        z = self.prepare(q)
        out = np.empty((len(z), len(self.books), self.spec.k))
        for i, ((a, b), c) in enumerate(zip(self.spans, self.books, strict=True)):
            out[:, i] = codebook.sq_dists(z[:, a:b], c) if self.spec.reduction == "l2" else z[:, a:b] @ c.T
        return out

    def luts_of(self, q: np.ndarray) -> np.ndarray:
        """VQ13, VQ14: quantised as the spec says."""
        raw = self.raw_luts(q)
        if self.spec.quantize == "none":
            return raw
        if self.spec.quantize == "half":
            return lutquant.quantize_half(raw, self.offsets, self.scale)
        if self.spec.quantize == "rint":
            return np.clip(np.rint((raw - self.offsets[:, None]) * self.scale), 0, 255).astype(np.int64)
        return lutquant.quantize(raw, self.offsets, self.scale)

    def luts(self, queries: DataFrame, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, lut): one flat table a query, made before any join, so that it is made once."""
        whole = self.spec.quantize != "none"
        kind = (T.IntegerType(), pa.int32()) if whole else (T.DoubleType(), pa.float64())
        out = map_rows(queries, vector, [query_id], [("lut", T.ArrayType(kind[0]), kind[1])], lambda q: [(t := self.luts_of(q)).reshape(len(t), -1)])
        return out.withColumnRenamed(query_id, "query_id")

    # ------------------------------------------------ scans

    def _dist(self, codes: str, lut: str):
        n, k, c, t = self.spec.n_codebooks, self.spec.k, F.col(codes), F.col(lut)
        return {
            "sum": lambda: V.lut_sum(c, t, n, k),
            "u8": lambda: V.lut_sum_u8(c, t, n, k),
            "pairs": lambda: V.lut_sum_pairs(c, t, n, k),
            "grouped": lambda: V.lut_sum_grouped(c, t, n, k, self.spec.every),
            "mean": lambda: V.lut_mean(c, t, n, k, self.spec.every),
        }[self.spec.accumulate]()

    def _unquantized(self, dist):
        """VQ18."""
        if self.spec.quantize == "none":
            return dist.cast("double")
        return dist.cast("double") / F.lit(float(self.scale)) + F.lit(float(self.offsets.sum()))

    def transform(self, codes: DataFrame, queries: DataFrame, id_col: str = "vec_id", query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """VQ05-VQ11: (query_id, id, dist_q, dist) of all codes against all queries; the tables are the broadcast side, if they are few."""
        n = self.spec.n_codebooks
        luts = self.luts(queries, query_id, vector)
        if n <= MOST_UNROLLED:
            pairs = codes.crossJoin(knn.few(luts)).select("query_id", F.col(id_col).alias("id"), self._dist("codes", "lut").alias("dist_q"))
        else:
            pairs = self._scan_wide(codes, luts, id_col)
        return pairs.withColumn("dist", self._unquantized(F.col("dist_q")))

    def _scan_wide(self, codes: DataFrame, luts: DataFrame, id_col: str) -> DataFrame:
        """More codebooks than are unrolled: the tables of some queries at a time travel to every task."""
        flat, out = np.arange(self.spec.n_codebooks) * self.spec.k, None
        for ids, table in knn.blocks(luts, "query_id", "lut"):

            def run(batches, ids=ids, table=table):
                for b in batches:
                    if b.num_rows:
                        got = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + flat
                        own = b.column(0).to_numpy(zero_copy_only=False)
                        for q, t in zip(ids, table, strict=True):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q)), pa.array(own, pa.int64()), pa.array(t[got].sum(1))], names=["query_id", "id", "dist_q"])

            part = codes.select(F.col(id_col).cast("long"), "codes").mapInArrow(run, "query_id long, id long, dist_q double")
            out = part if out is None else out.union(part)
        return codes.sparkSession.createDataFrame([], "query_id long, id long, dist_q double") if out is None else out

    def knn(self, codes: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """KNN04, KNN05: (query_id, id, dist_q, dist, rank) of the k nearest by codes; products are ordered from the largest, ties by id.

        With plain or clipped sums every Arrow batch looks all queries of a block up at once and passes on what may be among the k nearest of
        each, so that the scan's rows aren't sorted. Other accumulations scan in the JVM and rank all rows.
        """
        sign = 1 if self.spec.reduction == "l2" else -1
        if self.spec.accumulate not in ("sum", "u8"):
            scanned = self.transform(codes, queries, id_col, query_id, vector)
            return knn.top_k(scanned, "query_id", [F.col("dist_q") * sign, F.col("id")], k)
        top, out = 255 if self.spec.accumulate == "u8" else None, None
        for ids, q in knn.blocks(queries, query_id, vector):
            where = codes.sparkSession.sparkContext.broadcast((ids, self._paired(self.luts_of(q))))  # a block's tables

            def run(batches, where=where):
                ids, tables = where.value
                limit = None
                for b in batches:
                    if not b.num_rows:
                        continue
                    own = b.column(0).to_numpy(zero_copy_only=False)
                    at = self._pairs_of(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                    step = max(256, SCAN_CELLS // len(ids))
                    for lo in range(0, len(own), step):
                        part = at[:, lo : lo + step]
                        dist = tables[0][part[0]]  # (rows, queries): whole rows of a table are added up
                        for table, codes_ in zip(tables[1:], part[1:], strict=True):
                            dist += table[codes_]
                        dist = dist if top is None else np.minimum(dist, top)
                        i, query, limit = knn.nearest(dist * sign, k, limit)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(own[lo + i], pa.int64()), pa.array(dist[i, query].astype(np.float64))], names=["query_id", "id", "dist_q"])

            part = codes.select(F.col(id_col).cast("long"), "codes").mapInArrow(run, "query_id long, id long, dist_q double")
            out = part if out is None else out.union(part)
        if out is None:
            out = codes.sparkSession.createDataFrame([], "query_id long, id long, dist_q double")
        out = out.withColumn("dist", self._unquantized(F.col("dist_q")))
        return knn.top_k(out, "query_id", [F.col("dist_q") * sign, F.col("id")], k)

    def _paired(self, tables: np.ndarray) -> list[np.ndarray]:
        """(code, queries) tables of two codebooks each, where two codes fit in 12 bits: half the lookups. Whole numbers in few bytes."""
        if self.spec.quantize != "none":
            tables = tables.astype(np.int16 if tables.shape[1] * int(tables.max(initial=0)) < 1 << 15 else np.int32)
        t = np.ascontiguousarray(tables.transpose(1, 2, 0))
        if self.spec.k > 64:
            return list(t)
        out = [(t[c][:, None] + t[c + 1][None]).reshape(-1, t.shape[2]) for c in range(0, len(t) - 1, 2)]
        return out + ([t[-1]] if len(t) % 2 else [])

    def _pairs_of(self, codes: np.ndarray) -> np.ndarray:
        """(tables, rows): the places in ``_paired`` tables."""
        codes = codes.T.astype(np.int32)
        if self.spec.k > 64:
            return codes
        even = len(codes) // 2 * 2
        return np.concatenate([codes[0:even:2] * self.spec.k + codes[1:even:2], codes[even:]])

    def reconstruct(self, codes: np.ndarray) -> np.ndarray:
        return codebook.decode(codes, self.books)

    # ------------------------------------------------ storage

    def save(self, spark: SparkSession, path: str) -> None:
        """SNK05: one row of JSON in Parquet."""
        state = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items() if k not in ("spec", "books")}
        state |= {"spec": asdict(self.spec), "books": [b.tolist() for b in self.books]}
        spark.createDataFrame([(json.dumps(state),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    s = json.loads(spark.read.parquet(path).first()["model"])
    array = lambda x: None if x is None else np.array(x)
    return Model(Spec(**s["spec"]), s["dim"], array(s["mean"]), s["places"], array(s["rotation"]), [np.array(b) for b in s["books"]], s["trees"], array(s["offsets"]), s["scale"])


def fit_sample(x: np.ndarray, spec: Spec, queries: np.ndarray | None = None, mean: np.ndarray | None = None) -> Model:
    """VQ21: from a sample in memory, in any combination of preprocessing and encoding."""
    dim = x.shape[1]
    if dim < spec.n_codebooks:
        raise ValueError(f"{dim} components are fewer than {spec.n_codebooks} codebooks")
    mean = (x.mean(0) if mean is None else mean) if spec.centered else np.zeros(dim)
    places = V.padded(dim, spec.n_codebooks)
    if spec.preproc.startswith(("perm", "corr")):
        cov = np.cov((x - mean).T, bias=True).reshape(dim, dim)
        stat = linalg.correlation(cov) if spec.preproc.startswith("corr") else cov
        perm = linalg.threshold_permutation(stat, max(1, len(places) // spec.n_codebooks), "sample" if spec.preproc.endswith("sample") else "top", spec.seed)
        places = perm + [-1] * (len(places) - dim)
    m = Model(spec, dim, mean, places, None, [])
    z = m.prepare(x)
    if spec.preproc in ("rotate", "rotate_blocks"):
        m.rotation, m.books = codebook.learn_rotated(z, m.spans, spec.k, None, spec.block if spec.preproc == "rotate_blocks" else None, seed=spec.seed)
        z = m.prepare(x)
    if spec.encode == "kmeans":
        if not m.books:
            m.books, _ = codebook.learn(z, m.spans, spec.k, seed=spec.seed)
    else:
        levels = int(np.log2(spec.k))
        for a, b in m.spans:
            if spec.encode == "tree":
                m.trees.append(tree.learn_tree(z, levels, 4, range(a, b)))
            else:
                cuts = tree.learn_splits(z[:, a:b], levels)
                m.trees.append([{"dim": a + d, "vals": [v] * 2**i} for i, (d, v) in enumerate(cuts)])
        codes = np.stack([tree.tree_codes(z, t) for t in m.trees], 1)
        m.books = codebook.update(z, codes, m.spans, spec.k)
    if spec.quantize != "none":
        q = queries if queries is not None else x[np.random.default_rng(spec.seed).permutation(len(x))[: spec.train_queries]]
        raw = m.raw_luts(q)
        m.offsets, m.scale = lutquant.power_of_two(raw) if spec.quantize == "half" else lutquant.grid(raw)[:2]
    return m


def fit(df: DataFrame, spec: Spec, id_col: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None) -> Model:
    """VQ19: the mean is taken over all rows, the rest is trained on a bounded sample."""
    x = sample(df, vector, spec.sample, id_col, spec.seed)
    if not len(x):
        raise ValueError("no vectors to train on")
    mean = linalg.column_means(df, vector) if spec.centered else None
    q = None if queries is None else sample(queries, vector, spec.train_queries, id_col, spec.seed)
    return fit_sample(x, spec, q, mean)


def fixed(books: list[np.ndarray], spec: Spec, **more) -> Model:
    """A model with given codebooks, without centring."""
    dim = sum(b.shape[1] for b in books)
    return Model(replace(spec, center=False), dim, np.zeros(dim), list(range(dim)), None, books, **more)
