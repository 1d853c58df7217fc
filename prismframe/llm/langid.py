"""Language identification: bit-sliced Bloom filters over byte n-grams, per-language popcounts, false positives taken off.

Fit, on a bounded sample of labelled rows: for every language the commonest n-grams of its texts go into a Bloom filter. All
filters share their hash functions and lie beside one another, so one slot holds a bitmask of languages and the AND over an
n-gram's slots is the set of all languages that contain it. Predict: the popcount of every language over a text's n-grams, less
what the fill of its filter would give by chance, as a share of the n-grams; the largest share decides.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; otherwise a learned
language, on ties the alphabetically first. Every text is read whole, a very long one in slices. Nothing but the text enters a prediction.
Repeated rows give repeated results and are learned from once; input columns named lang_pred, score or known give way; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.llm import common

UND = "und"


def _letters() -> np.ndarray:
    """Bytes as the n-grams see them: A-Z lower-cased, all other ASCII but a-z a blank, others as they are."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


@dataclass(frozen=True)
class Settings:
    per_lang: int = 600  #: labelled texts of a language that are learned from, at most
    n: int = 4  #: bytes of an n-gram
    grams: int = 20_000  #: n-grams kept of a language, at most
    purity: float = 0.05  #: an n-gram's rate in a language against its highest rate in any, at least
    slots_log2: int = 18
    hashes: int = 3


@dataclass
class Model:
    langs: list[str]
    slices: np.ndarray  # (words, slots): bitmasks of 8 languages each
    fill: np.ndarray  # expected false positives of each language
    settings: Settings


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each byte but the last n - 1, as a number; runs of blanks are kept as they are."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out |= data[i : i + m].astype(np.uint64) << np.uint64(8 * i)
    return out


def _slots(codes: np.ndarray, s: Settings) -> list[np.ndarray]:
    mixed = common.mix64(codes)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return [((mixed + np.uint64(i) * step) & np.uint64((1 << s.slots_log2) - 1)).astype(np.int64) for i in range(s.hashes)]


def _useful(codes: np.ndarray, n: int) -> np.ndarray:
    """Not those with two blanks side by side or nothing but blanks: junk and tables are full of them."""
    blank = [((codes >> np.uint64(8 * i)) & np.uint64(255)) == 32 for i in range(n)]
    bad = np.zeros(len(codes), bool)
    for a, b in zip(blank, blank[1:], strict=False):
        bad |= a & b
    return ~bad


def train(samples: dict[str, list[str]], s: Settings = Settings()) -> Model:
    table, langs, rates = _letters(), sorted(samples), []
    for lang in langs:
        data = table[np.frombuffer(" \0 ".join(samples[lang]).encode("utf-8", "replace"), np.uint8)] if samples[lang] else np.zeros(0, np.uint8)
        codes = _codes(data, s.n)
        grams, counts = np.unique(codes[_useful(codes, s.n)], return_counts=True)
        top = np.argsort(-counts, kind="stable")[: s.grams]
        top = top[counts[top] >= min(3, counts.max(initial=1))]
        rates.append((grams[top], counts[top] / max(1, counts.sum())))
    best: dict[int, float] = {}
    for grams, rate in rates:
        for g, r in zip(grams.tolist(), rate.tolist(), strict=True):
            best[g] = max(best.get(g, 0.0), r)
    slices = np.zeros((max(1, -(-len(langs) // 8)), 1 << s.slots_log2), np.uint8)
    fill = np.zeros(len(langs))
    for i, (grams, rate) in enumerate(rates):
        kept = grams[rate >= s.purity * np.array([best[g] for g in grams.tolist()])] if len(grams) else grams
        row, bit = slices[i // 8], np.uint8(1 << (i % 8))
        for slot in _slots(kept, s):
            row[slot] |= bit
        fill[i] = ((row & bit) > 0).mean() ** s.hashes
    return Model(langs, slices, fill, s)


def scores(model: Model, arr: pa.Array, most: int = 4 << 20) -> np.ndarray:
    """(texts, languages): the corrected share of each text's n-grams that each language contains; ``most`` bytes are looked at at a time."""
    s, table = model.settings, _letters()
    data, offsets = common.utf8(arr)
    hits, total = np.zeros((len(arr), len(model.langs))), np.zeros(len(arr))
    for lo in range(0, len(data), most):
        # a slice goes on for the n-gram that starts with its last byte
        part = data[lo : lo + most + s.n - 1]
        more, n = _hits(model, table[part], np.clip(offsets - lo, 0, len(part)), min(most, len(part)))
        hits += more
        total += n
    share = hits / np.maximum(total, 1)[:, None]
    return np.clip((share - model.fill) / np.maximum(1e-9, 1 - model.fill), 0, 1)


def _hits(model: Model, data: np.ndarray, offsets: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many n-grams that start in the first ``starts`` bytes each language contains, and how many there are."""
    s, rows, n_langs = model.settings, len(offsets) - 1, len(model.langs)
    codes = _codes(data, s.n)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    inside = owner[: len(codes)] == owner[s.n - 1 :] if len(codes) else np.zeros(0, bool)
    inside &= _useful(codes, s.n)
    inside[starts:] = False
    codes, owner = codes[inside], owner[: len(inside)][inside]
    total = np.bincount(owner, minlength=rows).astype(float)
    hits = np.zeros((rows, n_langs))
    slots = _slots(codes, s)
    for w, row in enumerate(model.slices):
        mask = row[slots[0]]
        for slot in slots[1:]:
            mask &= row[slot]
        seen = np.bincount(owner * 256 + mask, minlength=rows * 256).reshape(rows, 256)
        here = np.arange(w * 8, min(n_langs, w * 8 + 8))
        bits = (np.arange(256)[:, None] >> (here - w * 8)) & 1
        hits[:, here] = seen @ bits
    return hits, total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``lang_pred``, ``score`` (the best share as a part of all shares), ``known`` (the best share itself)."""
    where = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: slots x languages / 8 bytes

    def fn(arr: pa.Array) -> list[pa.Array]:
        m = where.value
        if not m.langs:
            return [pa.array([UND] * len(arr)), pa.array(np.zeros(len(arr))), pa.array(np.zeros(len(arr)))]
        got = scores(m, arr)
        best = got.argmax(1)
        top, total = got.max(1), got.sum(1)
        letter = np.array([has_letter(x) for x in arr.to_pylist()], bool)
        score = np.where(letter & (total > 0), top / np.maximum(total, 1e-12), 0.0)
        return [pa.array([m.langs[b] if ok else UND for b, ok in zip(best, letter, strict=True)], pa.string()), pa.array(score), pa.array(np.where(letter, top, 0.0))]

    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]
    return common.map_text(docs, text, keep, out, fn)


def fit(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> Model:
    """From rows with a language; the caller keeps held-out rows away."""
    samples = common.labelled_sample(docs, lang, id_col, text, s.per_lang)
    return train({str(k): v for k, v in samples.items()}, s)
