"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window lengths compared, thresholds calibrated.

Fit, on a bounded sample of labelled rows, in halves told apart by the text, so that no text is measured with what was trained on it:

1. Two dictionaries are trained by zstandard, each on texts of its own class: one on windows of ordinary, one on windows of toxic texts.
2. The distance of a piece of text is how many bytes shorter it becomes when the toxic dictionary is there beside the ordinary one. As toxic
   texts are mostly ordinary prose, the toxic dictionary is refined ``rounds`` times: it is trained again on those words of toxic texts whose
   distance, by the other half's dictionaries, is beyond ``quantile`` of the words of ordinary texts. What both explain costs the same then.
3. A text is cut into windows of ``words`` words. Its features are how many windows, and which share, reach each distance. A logistic
   regression on the other half's distances makes a probability of them, so that no threshold is set by hand.

A fixed tail, which follows every window and ends both dictionaries, takes two effects away from the window: zstandard looks for no match in a
block's last bytes, and stores a block raw that gains too little.

Defined results: a null or empty text, or one without words, has the score of no toxic window at all. Without labels of both
kinds the score is the share of toxic labels (0.5 without any). A document with several labels is toxic if one of them is.
Texts are read whole, very long ones too (a window at a time); nothing but the text enters a score. Repeated rows give repeated
results; rows equal in id and text are learned from once; an input column called score or predicted gives way; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.llm import common

WORDS = re.compile(r"[^\W\d_]+")
#: Follows every window; in no text, at the end of both dictionaries.
TAIL = bytes(range(1, 9)) * 6


@dataclass(frozen=True)
class Settings:
    per_label: int = 2500  #: texts of a label that are learned from, at most
    words: int = 6  #: words of a window; one begins where the last one ends
    ordinary_bytes: int = 32_000
    toxic_bytes: int = 6_000
    segment: int = 16  #: bytes that the trainer takes at a time
    samples: int = 40_000  #: windows that a dictionary is trained on, at most
    rounds: int = 3
    quantile: float = 0.999
    farthest: int = 10  #: distances are told apart up to so many bytes


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    settings: Settings

    def __getstate__(self):
        return {**self.__dict__, "distance": None}

    def distances(self) -> Callable[[bytes], int]:
        if self.__dict__.get("distance") is None:
            plain, both = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
            self.__dict__["distance"] = lambda w: max(0, plain(w) - both(w))
        return self.__dict__["distance"]


def compressor(dictionary: bytes) -> Callable[[bytes], int]:
    """The compressed length of a window with a dictionary."""
    how = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=7, min_match=4, strategy=zstandard.STRATEGY_LAZY2, target_length=16,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    content = zstandard.ZstdCompressionDict(dictionary + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress
    return lambda w: len(compress(w + TAIL))


def dictionary(samples: list[bytes], size: int, s: Settings) -> bytes:
    """The content of a dictionary that zstandard trains on samples of one class."""
    samples = [x for x in samples if len(x) >= 8]  # the trainer reads no shorter ones
    drawn = np.random.default_rng(0).permutation(len(samples))[: s.samples]
    samples = [samples[i] for i in drawn]
    size = min(size, max(300, sum(map(len, samples)) // 2))
    try:
        return zstandard.train_dictionary(size + 400, samples, d=6, k=s.segment).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:]


def words(text: str) -> list[bytes]:
    return [f" {w} ".encode() for w in WORDS.findall(text.lower())]


def windows(text: str, n: int) -> Iterator[bytes]:
    held: list[str] = []
    for m in WORDS.finditer(text.lower()):
        held.append(m.group())
        if len(held) == n:
            yield f" {' '.join(held)} ".encode()
            held = []
    if held:
        yield f" {' '.join(held)} ".encode()


def features(model: Model, text: str) -> np.ndarray:
    """1, the largest distance, then for each distance the log count and the share of windows at least so far."""
    most, distance = model.settings.farthest, model.distances()
    counts = np.zeros(most + 1)
    for w in windows(text, model.settings.words):
        counts[min(most, distance(w))] += 1
    n = counts.sum()
    beyond = counts[::-1].cumsum()[::-1][1:]
    far = np.flatnonzero(beyond)
    return np.concatenate([[1.0, (far[-1] + 1) / most if len(far) else 0.0], np.log1p(beyond), beyond / max(1, n) * 10, [np.log1p(n) / 5]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton's method with a ridge on all weights but the first, which carries the constant."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def far_words(toxic: list[str], ordinary: list[str], model: Model) -> list[bytes]:
    """For each toxic text its words beyond the distance that ``quantile`` of the words of ordinary texts don't pass."""
    distance, known = model.distances(), {}

    def far(w: bytes) -> int:
        if w not in known:
            known[w] = distance(w)
        return known[w]

    seen = Counter(far(w) for x in ordinary for w in words(x))
    least, allowed = 1, (1 - model.settings.quantile) * sum(seen.values())
    while sum(n for d, n in seen.items() if d >= least) > allowed:
        least += 1
    found = (b" ".join(w for w in words(x) if far(w) >= least) for x in toxic)
    return [x for x in found if x]


def train(toxic: list[str], ordinary: list[str], s: Settings = Settings()) -> Model:
    """From texts of both kinds, in any order: halves are told apart by the text itself."""

    def halves(xs: list[str]) -> list[list[str]]:
        a, b = ([x for x in xs if zlib.crc32(x.encode()) % 2 == h] for h in (0, 1))
        return [a or b, b or a]

    t, o = halves(toxic), halves(ordinary)
    none = np.zeros(0)
    plain = [dictionary([w for x in half for w in windows(x, 8)], s.ordinary_bytes, s) for half in o]
    models = [Model(plain[h], dictionary([w for x in t[h] for w in windows(x, 8)], 4 * s.toxic_bytes, s), none, s) for h in (0, 1)]
    chosen: list[list[bytes]] = [[], []]
    for _ in range(s.rounds):
        chosen = [far_words(t[h], o[h], models[1 - h]) or chosen[h] for h in (0, 1)]
        models = [Model(plain[h], dictionary(chosen[h], s.toxic_bytes, s), none, s) for h in (0, 1)]
    rows = [(features(models[1 - h], x), y) for h in (0, 1) for y, xs in ((1, t[h]), (0, o[h])) for x in xs]
    weights = logistic(np.array([f for f, _ in rows]), np.array([y for _, y in rows], float))
    whole = dictionary([w for half in o for x in half for w in windows(x, 8)], s.ordinary_bytes, s)
    return Model(whole, dictionary(chosen[0] + chosen[1], s.toxic_bytes, s), weights, s)


def probability(model: Model, text: str, shift: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(features(model, text) @ model.weights + shift, -30, 30))))


@dataclass
class Fitted:
    model: Model | None
    shift: float  # takes the score from the sample's share of toxic rows to that of all labelled rows
    prior: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings = Settings()) -> Fitted:
    """``labels`` has the rows to learn from only. The sample's ids are chosen from the labels, then their texts are read."""
    marked = labels.filter(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    if not counts.get(1) or not counts.get(0):
        return Fitted(None, 0.0, prior)
    # keys of the sample first, the smallest by hash of each label; then their texts
    t = F.xxhash64(F.col(f"`{text}`"))
    share = {y: min(1.0, (1.5 * s.per_label + 20) / c) for y, c in counts.items()}
    uniform = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.filter(uniform < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share.get(0, 0.0)))).withColumnRenamed(id_col, "__id")
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), t.alias("t"))
    keys = keyed.join(chosen, "__id").distinct().withColumn("h", F.xxhash64(F.col("__id").cast("string"), "t"))
    got = [r for y in (0, 1) for r in keys.filter(F.col("y") == y).orderBy("h", "__id", "t").limit(s.per_label).collect()]
    rows = docs.sparkSession.createDataFrame(got, keys.schema)  # 2 * per_label rows at most
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), t.alias("t"), F.col(f"`{text}`").alias("x"))
    texts = source.join(F.broadcast(rows), ["__id", "t"]).groupBy("y", "h", "__id").agg(F.first("x").alias("x"))
    picked: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(texts.collect(), key=lambda r: (r["y"], r["h"])):
        picked[r["y"]].append(r["x"] or "")
    if not picked[0] or not picked[1]:
        return Fitted(None, 0.0, prior)
    rate = len(picked[1]) / (len(picked[0]) + len(picked[1]))
    shift = float(np.log(prior / (1 - prior)) - np.log(rate / (1 - rate)))
    return Fitted(train(picked[1], picked[0], s), shift, prior)


def score(docs: DataFrame, fitted: Fitted, keep: list[str], text: str = "text", at: float = 0.3) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` (score >= ``at``), one row a document."""
    where = docs.sparkSession.sparkContext.broadcast(fitted)  # two dictionaries of some KB

    def fn(arr: pa.Array) -> list[pa.Array]:
        f = where.value
        got = np.array([f.prior if f.model is None else probability(f.model, x or "", f.shift) for x in arr.to_pylist()])
        return [pa.array(got, pa.float64()), pa.array((got >= at).astype(np.int32))]

    return common.map_text(docs, text, keep, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], fn)
