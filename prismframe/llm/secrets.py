"""Secret scans by a trigram inverted index: Boolean trigram queries from each rule, postings intersected, candidates verified.

A rule is a regular expression. Its syntax tree gives a query over trigrams (AND / OR) that every text with a match satisfies; a
rule from which no trigram can be derived is verified on every text. The index is built piece by piece of the table (some MB of text), in one
pass over the piece's bytes with ASCII letters folded: the postings of every trigram that a rule asks for are the sorted texts that contain it.
Queries intersect and unite postings. Postings never leave their piece, so nothing is shuffled and nothing grows with the table.

Defined results: null texts are empty; spans are code points, end exclusive; a kind's matches are leftmost and don't overlap;
a match whose checked group is shorter than the rule asks is dropped after that. Texts are read whole, in time that grows with their length
for every rule here; a very long one is a piece of its own. Repeated rows give repeated results; input columns named like an output give way; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prismframe.llm import common

ALL = ("all",)  # the query that every text satisfies
MOST = 64  # strings that a part of a rule may stand for before its trigrams are given up


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    pivot: str = ""  # the end of the pattern, from its second literal on, if its matches are found from there

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self.pivot:
            return pivoted(text, self.pivot)
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


TOKEN = re.compile("[A-Za-z0-9_-]*+")


def pivoted(text: str, pivot: str) -> list[tuple[int, int]]:
    """Matches of ``eyJ`` and at least eight token characters before each place of the pivot: from the left, a start that fails would read on to the next dot."""
    out, at, ahead, ends = [], 0, 0, re.compile(pivot)
    while m := ends.search(text, ahead):
        back = TOKEN.match(text[max(at, text.rfind(".", at, m.start()) + 1) : m.start()][::-1]).end()
        start = text.find("eyJ", m.start() - back, m.start() - 8) if back >= 11 else -1
        if start >= 0:
            out.append((start, m.end()))
            at = ahead = m.end()
        else:
            ahead = m.start() + 1
    return out


def either_case(word: str) -> str:
    """The pattern of an ASCII word in letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
#: The three base kinds.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Publicly documented shapes of further credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", pivot=r"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", rf"{either_case('bearer')}\x20+[A-Za-z0-9_.~+/-]{{20,}}=*"),
)


# ---------------------------------------------------------------- regular expression -> trigram query


def _and(*qs: tuple) -> tuple:
    parts = {p for q in qs if q != ALL for p in (q[1] if q[0] == "and" else (q,))}
    return ALL if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _or(*qs: tuple) -> tuple:
    if not qs or ALL in qs:
        return ALL
    parts = {p for q in qs for p in (q[1] if q[0] == "or" else (q,))}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _holds(words: set[str]) -> tuple:
    """A text that contains one of these words satisfies this."""
    return _or(*(_and(*(("tri", w[i : i + 3]) for i in range(len(w) - 2))) if len(w) > 2 else ALL for w in words))


def _chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < 4:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def fold(text: str) -> str:
    return text.lower()


def trigram_query(pattern: str) -> tuple:
    """ALL, ("tri", xyz), ("and", queries) or ("or", queries); trigrams are folded."""

    def walk(nodes) -> tuple:
        """The query of a sequence: words that stand for its pieces are joined as long as they are few."""
        found, words = ALL, {""}
        for op, arg in nodes:
            name, exact = str(op), None
            if name == "LITERAL":
                exact = {fold(chr(arg))}
            elif name == "IN" and str(arg[0][0]) != "NEGATE" and (got := _chars(arg)) is not None:
                exact = {fold(c) for c in got}
            elif name == "SUBPATTERN":
                exact, inner = whole(arg[3]), walk(arg[3])
                found = _and(found, inner)
            elif name == "BRANCH":
                each = [whole(b) for b in arg[1]]
                exact = None if None in each else set().union(*each)
                found = _and(found, _or(*map(walk, arg[1])))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, body = arg
                one = whole(body)
                if most == 1 and least == 0 and one is not None:
                    exact = one | {""}
                elif one is not None and len(one) == 1 and least == most and least < 40:
                    exact = {next(iter(one)) * least}
                elif least:
                    found = _and(found, walk(body))
            elif name == "AT":
                exact = {""}
            joined = None if exact is None or len(words) * len(exact) > MOST else {a + b for a, b in product(words, exact)}
            if joined is None:
                found, words = _and(found, _holds(words)), exact or {""}
            else:
                words = joined
        return _and(found, _holds(words))

    def whole(nodes) -> set[str] | None:
        """All strings that a sequence matches, folded, or None if they are many or unlike."""
        words = {""}
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                more = {fold(chr(arg))}
            elif name == "IN" and str(arg[0][0]) != "NEGATE":
                more = _chars(arg)
                more = None if more is None else {fold(c) for c in more}
            elif name == "SUBPATTERN":
                more = whole(arg[3])
            elif name == "BRANCH":
                each = [whole(b) for b in arg[1]]
                more = None if None in each else set().union(*each)
            elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1 and (one := whole(arg[2])) is not None:
                more = one | {""}
            else:
                more = None
            if more is None or len(words) * len(more) > MOST:
                return None
            words = {a + b for a, b in product(words, more)}
        return words

    return walk(list(re._parser.parse(pattern)))


def trigrams(query: tuple) -> set[str]:
    return set() if query == ALL else {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


class Index:
    """The inverted index of one piece of the table: for each trigram asked for, the sorted texts that contain it."""

    def __init__(self, texts: pa.Array, asked: set[str]):
        data, offsets = common.utf8(texts)
        self.n = len(texts)
        folded = np.arange(256, dtype=np.uint8)
        folded[65:91] += 32
        data = folded[data].astype(np.uint32)
        codes = data[:-2] | data[1:-1] << 8 | data[2:] << 16 if len(data) > 2 else np.zeros(0, np.uint32)
        names = sorted(t for t in asked if t.isascii())
        wanted = np.array([int.from_bytes(t.encode(), "little") for t in names], np.uint32)
        seen = np.zeros(1 << 24, bool)
        seen[wanted] = True
        at = np.flatnonzero(seen[codes])
        owner = np.searchsorted(offsets, at, "right") - 1
        whole = at + 3 <= offsets[owner + 1]  # not over the end of a text
        at, owner = at[whole], owner[whole]
        by = np.argsort(wanted)
        place = by[np.searchsorted(wanted[by], codes[at])] if len(names) else at
        pairs = np.unique(place.astype(np.int64) * max(1, self.n) + owner)
        cuts = np.searchsorted(pairs, np.arange(len(names) + 1) * max(1, self.n))
        self.postings = {t: pairs[cuts[i] : cuts[i + 1]] - i * max(1, self.n) for i, t in enumerate(names)}

    def candidates(self, query: tuple) -> np.ndarray:
        """The sorted texts that satisfy a query. What has a trigram beyond ASCII isn't indexed: such a query lets every text through."""
        if query == ALL or (query[0] == "tri" and query[1] not in self.postings):
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def scan(arr: pa.Array, rules: tuple[Rule, ...], queries: list[tuple] | None = None) -> list[list[tuple[int, int, int]]]:
    """For every text its (start, rule's place, end), sorted."""
    queries = queries or [trigram_query(r.pattern) for r in rules]
    index, texts, out = Index(arr, set().union(*map(trigrams, queries))), arr.to_pylist(), [[] for _ in range(len(arr))]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in index.candidates(query).tolist():
            out[i] += [(a, k, b) for a, b in rule.spans(texts[i] or "")]
    return [sorted(x) for x in out]


def find_secrets(
    docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE
) -> DataFrame:
    """``keep``, ``n_<kind>`` of the base rules, ``base_sha256`` and ``spans``, one row a document."""
    queries = [trigram_query(r.pattern) for r in rules]
    n_base = len(base)
    assert rules[:n_base] == base

    def fn(arr: pa.Array) -> list[pa.Array]:
        found = scan(arr, rules, queries)
        written = [[(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in x] for x in found]
        counts = [pa.array([sum(k == i for _, k, _ in x) for x in found], pa.int64()) for i in range(n_base)]
        digest = [hashlib.sha256(",".join(s for k, s in x if k < n_base).encode()).hexdigest() for x in written]
        return [*counts, pa.array(digest, pa.string()), pa.array([",".join(s for _, s in x) for x in written], pa.string())]

    out = [T.StructField(f"n_{r.kind}", T.LongType()) for r in base]
    out += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return common.map_text(docs, text, keep, out, fn)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, mask: Callable[[str], str] = lambda kind: f"[{kind}]") -> DataFrame:
    """All columns, with every span of the text replaced by the mask of its kind; of overlapping spans the first and longest."""
    queries = [trigram_query(r.pattern) for r in rules]

    def fn(arr: pa.Array) -> list[pa.Array]:
        given = arr.to_pylist()
        out = []
        for old, spans in zip(given, scan(arr, rules, queries), strict=True):
            at, parts = 0, []
            for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
                if a >= at:
                    parts += [old[at:a], mask(rules[k].kind)]
                    at = b
            out.append(old if old is None else "".join([*parts, old[at:]]))
        return [pa.array(out, pa.string())]

    return common.map_text(docs, text, [c for c in docs.columns if c != text], [T.StructField(text, T.StringType())], fn).select(*docs.columns)
