"""Nearest neighbours: exact top-k by blocks, radius joins, and classification by neighbours (KNN01-KNN11, DST04)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismframe.functions import vector as V
from prismframe.operators.arrow import matrix

#: Queries that travel to every task; a larger query set is searched in several passes of so many.
BLOCK = 4096


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows). DST04 for l2: norms less twice the product. Products and cosines are negated, so the least is nearest."""
    if metric == "l1":
        return np.stack([np.abs(x - r).sum(1) for r in q]) if len(q) else np.zeros((0, len(x)))
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            x, q = (np.nan_to_num(m / np.linalg.norm(m, axis=1, keepdims=True)) for m in (x, q))
    if metric in ("dot", "cosine"):
        return -(q @ x.T)
    return np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T)


def few(df: DataFrame, most: int = BLOCK) -> DataFrame:
    """For a join: broadcast if it has at most ``most`` rows, else as it is, and Spark deals both sides out."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, at most BLOCK at a time."""
    ids, rows = [], []
    for r in queries.select(query_id, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def _scan(base: DataFrame, id_col: str, vector: str, ids: np.ndarray, q: np.ndarray, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], metric: str, not_self: bool) -> DataFrame:
    """Rows (query_id, id, dist) that ``pick`` takes of each batch's distances."""
    where = base.sparkSession.sparkContext.broadcast((ids, q))  # BLOCK vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = where.value
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            dist = distances(matrix(b.column(1)), q, metric)
            if not_self:
                dist[ids[:, None] == own[None, :]] = np.inf
            a, i = pick(dist)
            ok = np.isfinite(dist[a, i])
            a, i = a[ok], i[ok]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[i], pa.int64()), pa.array(dist[a, i])], names=["query_id", "id", "dist"])

    rows = base.select(F.col(id_col).cast("long").alias("id"), vector).filter(F.col(vector).isNotNull())
    return rows.mapInArrow(run, "query_id long, id long, dist double")


def nearest(dist: np.ndarray, k: int, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of distances (rows, queries): the (row, query) that may be among the k nearest, and a limit for the task's next rows.

    ``limit`` has for every query a distance that k rows of the task don't pass; ties with it count, so that ids decide.
    """
    n = len(dist)
    if limit is not None:
        i, q = np.nonzero(dist <= limit)
        if len(i) <= 4 * k * dist.shape[1]:
            return i, q, limit
    if n <= k:
        return *np.nonzero(np.ones(dist.shape, bool)), limit
    own = np.partition(dist, k - 1, axis=0)[k - 1]
    limit = own if limit is None else np.minimum(own, limit)
    return *np.nonzero(dist <= limit), limit


def top_k(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """KNN03, KNN08: the first k rows of each key, ranked; partial limits run before the shuffle (WindowGroupLimit)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def exact_knn(base: DataFrame, queries: DataFrame, k: int, id_col: str, query_id: str, vector: str = "embedding", metric: str = "l2", not_self: bool = False) -> DataFrame:
    """KNN02-KNN05: (query_id, id, dist, rank), ties by id; fewer rows than k if the base has fewer. dist of dot and cosine is the product.

    Every batch sends its k nearest of each query; only those are shuffled and ranked.
    """

    def pick(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = dist.shape[1]
        # the k-th distance and all ties with it, so that ids decide
        limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if n > k else np.full((len(dist), 1), np.inf)
        return np.nonzero(dist <= limit)

    out = None
    for ids, q in blocks(queries, query_id, vector):
        part = _scan(base, id_col, vector, ids, q, pick, metric, not_self)
        out = part if out is None else out.union(part)
    if out is None:
        return base.sparkSession.createDataFrame([], "query_id long, id long, dist double, rank int")
    ranked = top_k(out, "query_id", [F.col("dist"), F.col("id")], k)
    return ranked.withColumn("dist", -F.col("dist")) if metric in ("dot", "cosine") else ranked


def radius_join(base: DataFrame, queries: DataFrame, r2: float, id_col: str, query_id: str, vector: str = "embedding") -> DataFrame:
    """KNN07: (query_id, id, dist) of all pairs nearer than r2, strictly, but not of a row with itself."""
    out = None
    for ids, q in blocks(queries, query_id, vector):
        part = _scan(base, id_col, vector, ids, q, lambda dist: np.nonzero(dist < r2), "l2", True)
        out = part if out is None else out.union(part)
    return out if out is not None else base.sparkSession.createDataFrame([], "query_id long, id long, dist double")


def nearest_lists(dists: DataFrame, k: int) -> DataFrame:
    """KNN06: (query_id, ids): the k nearest of rows (query_id, id, dist) as one list; what is behind the k-th never leaves its task."""
    ranked = top_k(dists, "query_id", [F.col("dist"), F.col("id")], k)
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))


def norm_expansion(rows: DataFrame, a: str, b: str) -> Column:
    """DST04 as a column: the squared distance of two vector columns from their norms and product."""
    return V.dot(F.col(a), F.col(a)) + V.dot(F.col(b), F.col(b)) - V.dot(F.col(a), F.col(b)) * 2


# ---------------------------------------------------------------- classification (KNN09-KNN11)


def nearest_center(rows: DataFrame, centers: dict[int, list[float]], vector: str = "embedding") -> DataFrame:
    """KNN09: adds ``pred``, the label of the nearest centre by -2xc + |c|^2; ties go to the smaller label."""
    scored = [F.struct((F.lit(sum(x * x for x in c)) - V.dot(F.col(vector), V.literal(c)) * 2).alias("s"), F.lit(label).alias("label")) for label, c in sorted(centers.items())]
    return rows.withColumn("pred", F.array_min(F.array(*scored))["label"])


def rbf_vote(rows: DataFrame, centers: DataFrame, gamma: float = 1.0, vector: str = "embedding", by: str = "vec_id") -> DataFrame:
    """KNN10: (by, pred): softmax of -gamma d^2 over all centres (center_id, center, label), summed by label; the largest sum wins.

    The centres are prototypes, few enough for every task; ties go to the smaller label.
    """
    table = [(r["label"], list(r["center"])) for r in centers.select("label", "center").collect()]
    d2 = [(label, V.l2(F.col(vector), V.literal(c))) for label, c in table]
    rows = rows.select(by, F.array(*(F.struct(F.lit(label).alias("label"), d.alias("d2")) for label, d in d2)).alias("all"))
    rows = rows.withColumn("least", F.array_min(F.transform("all", lambda x: x["d2"])))
    votes = rows.select(by, F.transform("all", lambda x: F.struct(x["label"].alias("label"), F.exp((F.col("least") - x["d2"]) * gamma).alias("w"))).alias("all"))

    def vote(label: int) -> Column:
        own = F.filter("all", lambda x: x["label"] == label)
        return F.struct((-F.aggregate(own, F.lit(0.0), lambda s, x: s + x["w"])).alias("w"), F.lit(label).alias("label"))

    sums = [vote(label) for label in sorted({label for label, _ in table})]
    return votes.select(by, F.array_min(F.array(*sums))["label"].alias("pred"))


def linear_argmax(rows: DataFrame, weights: dict[int, list[float]], bias: dict[int, float], vector: str = "embedding") -> DataFrame:
    """KNN11: adds ``pred``, the class of the largest product plus bias; ties go to the smaller class."""
    scored = [F.struct((-(V.dot(F.col(vector), V.literal(w)) + bias.get(c, 0.0))).alias("s"), F.lit(c).alias("label")) for c, w in sorted(weights.items())]
    return rows.withColumn("pred", F.array_min(F.array(*scored))["label"])
