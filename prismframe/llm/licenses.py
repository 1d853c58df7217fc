"""License scans: an exact set-similarity join of text blocks with license templates, by containment.

A template is a set of tokens; a block meets it if it holds at least ``threshold`` of them. Tokens are put in one global order,
rarest first, by the number of documents that hold them, counted over the whole table. With n tokens and a needed overlap of o,
a block that shares none of the template's first n - o + 1 tokens can't reach o: these prefixes are inverted, and a block looks up its own
tokens in the same order (prefix filter). A block of fewer than o tokens can't reach o (length filter). Nor can one whose shared tokens so far,
and the fewer of those that follow in the template and in the block, are too few together (positional filter). What is left is verified by the
whole intersection, so the result is exact. A text without a token of any prefix ends there.

Blocks are lines, and windows of consecutive words that run over line ends, as published notices wrap: at every place, as many words as the
template's text over its threshold, so that a few words between (comment marks such as dnl) do no harm. As lines that follow
each other by chance share words too, a window must also hold the threshold's share of the template's words in their order. Windows are joined
around the places of prefix tokens only. Phrases (the base labels) are templates too, with the whole text as their block and a threshold of 1, as their
words may run over a line's end; every place where the words stand consecutively is then verified.

Defined results: a null text is empty; a text without words has score 0 and null places; repeated rows give repeated results; texts are read
whole, very long ones too, and a text must fit in a worker's memory as words; input columns named like an output give way; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.llm import common

#: A word of the lower-cased text: digits, a-z and whatever is beyond ASCII. The same words on the text as it is written.
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
WRITTEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    return [w.translate(_LOWER) for w in WRITTEN.findall(text)]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8

    @property
    def tokens(self) -> frozenset[str]:
        return frozenset(words(self.text))


#: Phrase and label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
    " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
)
#: Notices and whole texts of public licenses. Where one word tells a license from another, all are needed.
TEMPLATES = (
    Template("mit", _MIT),
    Template("mit", "Released under the MIT License"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    Template("bsd", _BSD),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template(
        "mit",
        _MIT + " (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "bsd",
        _BSD + ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary"
        " form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with"
        " the distribution.",
    ),
    Template("bsd", _WARRANTY),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"
        " and this permission notice appear in all copies.",
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of"
        " this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it"
        " freely, subject to the following restrictions",
    ),
    Template(
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this"
        " license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,"
        " either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    Template("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    Template("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", 1.0),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", 1.0),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    Template("ofl-1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", 1.0),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", 1.0),
    Template("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
)


def needed(n: int, threshold: float) -> int:
    """The smallest overlap o with o / n >= threshold."""
    x = threshold * n - 1e-9
    return max(1, int(x) + (int(x) < x))


def document_frequencies(docs: DataFrame, vocabulary: frozenset[str], text: str = "text") -> dict[str, int]:
    """In how many documents each token of the vocabulary stands, over the whole table. Native; as many rows as tokens are collected."""
    lower = F.translate(F.col(f"`{text}`"), "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    there = F.array_intersect(F.split(lower, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), F.lit(sorted(vocabulary)))
    got = docs.select(F.explode(there).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r["token"]: r["n"] for r in got}


@dataclass
class Side:
    """A template in the global order."""

    label: str
    order: list[int]
    tokens: frozenset[int]
    need: int
    seq: list[int]  # the words of its text
    need_seq: int
    window: int
    places: dict[int, int]  # for each token a bit for each of its places in the text

    @property
    def prefix(self) -> list[int]:
        return self.order[: len(self.order) - self.need + 1]


class Ranks(dict):
    """Words as they are written, and their places in the global order; -1 for words of no template."""

    def __init__(self, order: list[str]):
        super().__init__((w, i) for i, w in enumerate(order))
        self.known = dict(self)

    def __missing__(self, written: str) -> int:
        rank = self.known.get(written.translate(_LOWER), -1)
        if len(self) < 1 << 20:
            self[written] = rank
        return rank


class Index:
    """The inverted prefixes of the templates."""

    def __init__(self, templates: tuple[Template, ...], rank: dict[str, int]):
        self.sides, self.postings = [], {}
        for t in templates:
            order, seq = sorted(rank[w] for w in t.tokens), [rank[w] for w in words(t.text)]
            places: dict[int, int] = {}
            for i, r in enumerate(seq):
                places[r] = places.get(r, 0) | 1 << i
            need_seq = needed(len(seq), t.threshold)
            self.sides.append(Side(t.label, order, frozenset(order), needed(len(order), t.threshold), seq, need_seq, needed(len(seq), 1 / t.threshold), places))
            for i, r in enumerate(self.sides[-1].prefix):
                self.postings.setdefault(r, []).append((len(self.sides) - 1, i))

    def candidates(self, block: list[int]) -> list[int]:
        """The templates that may be met by a block, given as its tokens in the global order."""
        n, shared = len(block), {}
        for j, r in enumerate(block):
            for t, i in self.postings.get(r, ()):
                side, so_far = self.sides[t], shared.get(t, 0)
                if so_far >= 0 and n >= side.need:
                    # what follows in the template and in the block bounds what is still to be shared
                    most = so_far + 1 + min(len(side.order) - i - 1, n - j - 1)
                    shared[t] = so_far + 1 if most >= side.need else -1
        return [t for t, k in shared.items() if k > 0]

    def join(self, block: set[int]) -> list[tuple[int, float]]:
        """The templates that a block meets, with their containment."""
        out = []
        for t in self.candidates(sorted(block)):
            overlap = len(block & self.sides[t].tokens)
            if overlap >= self.sides[t].need:
                out.append((t, overlap / len(self.sides[t].order)))
        return out


def in_order(a: list[int], side: Side) -> int:
    """The length of the longest common subsequence of some words and the template's, a bit for each of its words."""
    full = (1 << len(side.seq)) - 1
    v = full
    for x in a:
        u = v & side.places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(side.seq) - v.bit_count()


def join_windows(ranks: list[int], side: Side) -> float:
    """The largest containment of the template in a window of ``side.window`` consecutive words, or 0 below the threshold."""
    prefix = set(side.prefix)
    hits = [(i, r) for i, r in enumerate(ranks) if r in side.tokens]
    # a window that meets the template holds a token of its prefix
    anchors = [i for i, r in hits if r in prefix]
    held: dict[int, int] = {}
    best = a = x = 0
    for k, (i, r) in enumerate(hits):
        held[r] = held.get(r, 0) + 1
        while hits[a][0] <= i - side.window:
            gone = hits[a][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            a += 1
        while x < len(anchors) and anchors[x] < hits[a][0]:
            x += 1
        if x == len(anchors):
            break
        if anchors[x] <= i and len(held) >= side.need and len(held) > best and in_order([w for _, w in hits[a : k + 1]], side) >= side.need_seq:
            best = len(held)
    return best / len(side.order)


class Scanner:
    """Everything that a task needs, made once in it."""

    def __init__(self, phrases: tuple[tuple[str, str], ...], templates: tuple[Template, ...], frequency: dict[str, int]):
        whole = tuple(Template(label, phrase, 1.0) for phrase, label in phrases)
        tokens = frozenset().union(*(t.tokens for t in whole + templates))
        self.rank = Ranks(sorted(tokens, key=lambda w: (frequency.get(w, 0), w)))
        self.phrases, self.templates = Index(whole, self.rank), Index(templates, self.rank)
        self.prefixes = self.phrases.postings.keys() | self.templates.postings.keys()

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        rank = self.rank
        ranks = [rank[w] for w in WRITTEN.findall(text)]
        if self.prefixes.isdisjoint(ranks):
            return len(ranks), 0, None, None, "", "", 0.0
        there = set(ranks) - {-1}
        places, base, found, score = [], set(), {}, 0.0
        for t, _ in self.phrases.join(there):
            side = self.phrases.sides[t]
            k, n = side.seq.index(side.order[0]), len(side.seq)
            starts = [i - k for i, r in enumerate(ranks) if r == side.order[0] and i >= k and ranks[i - k : i - k + n] == side.seq]
            places += starts
            if starts:
                base.add(side.label)
                score = 1.0
        # a block's tokens are tokens of its text, so a template that the text as a whole doesn't hold needs no look at its blocks
        near = self.templates.join(there)
        for t, _ in near:
            found[t] = join_windows(ranks, self.templates.sides[t])
        if near:
            for line in text.split("\n"):
                for t, share in self.templates.join({rank[w] for w in WRITTEN.findall(line)} - {-1}):
                    found[t] = max(found[t], share)
        labels = {self.templates.sides[t].label for t, share in found.items() if share}
        score = max([score, *found.values()])
        return len(ranks), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def find_licenses(
    docs: DataFrame, keep: list[str], text: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """``keep``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``; one row a document."""
    vocabulary = frozenset(w for p, _ in phrases for w in words(p)) | frozenset().union(*(t.tokens for t in templates))
    frequency = document_frequencies(docs, vocabulary, text)

    out = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    out += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    made: list[Scanner] = []

    def fn(arr: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Scanner(phrases, templates, frequency))
        rows = [made[0].scan(x or "") for x in arr.to_pylist()]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return common.map_text(docs, text, keep, out, fn)
