"""Chat formatting, secrets, licenses, languages, toxicity and lines against plain versions."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismframe.llm import chat, common, langid, licenses, linededup, queries, secrets, toxicity

# ---------------------------------------------------------------- chat


def test_chat_round_trip_of_hostile_texts(spark):
    marks = [*chat.CHATML.control, chat.CHATML.begin, chat.CHATML.sep, chat.CHATML.end, "\\", "\\<|", "<\\|", "<", "\n", "é漢", ""]
    rng = random.Random(0)
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", None, "a\\<|b"]), rng.choice([t, t, None])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat.read_back(chat.render(chat.to_turns(df))).collect()
    for r in out:
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.parsed] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss_text == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        bare = r.formatted
        for m in (chat.CHATML.begin, chat.CHATML.sep, chat.CHATML.end):
            bare = bare.replace(m, "\0")
        assert not any(c in bare for c in chat.CHATML.control)


def test_chat_contract_row(spark, sf):
    row = queries.op1_chat_formatting(spark, sf).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_edges(spark):
    df = spark.createDataFrame(
        [(1, 1, "user", "b"), (1, 0, "system", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, "user", "x"), (2, None, None, "y")],
        "conv_id long, turn int, role string, text string",
    ).withColumns({c: F.lit("clash") for c in ("prompt", "turns", "part", "rows", "formatted")})
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.to_turns(df).collect()}
    assert got == {1: [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "x")], 2: [("", "y")]}
    assert chat.digest(chat.read_back(chat.render(chat.to_turns(df.limit(0))))).count() == 0
    many = spark.range(1000).selectExpr("1L AS conv_id", "CAST(id AS INT) AS turn", "'user' AS role", "CAST(id AS STRING) AS text")
    assert [t.text for t in chat.to_turns(many).first().turns] == [str(i) for i in range(1000)]


def test_schema_fingerprints(spark):
    rows = [({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"), ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
            ({"instruction": "q", "input": "", "output": "a"}, "instruction_input"), ({"instruction": "q", "output": "a"}, "instruction"), ({"prompt": "q", "completion": "a"}, "prompt_completion"),
            ({"question": "q", "answer": "a"}, "question_answer"), ({"prompt": "q", "response": "a"}, "prompt_response"), ({"odd": 1}, None)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(rows)] + [(99, None), (98, "no json")], "i int, j string")
    got = {r.i: r for r in chat.json_turns(df, "j").collect()}
    for i, (_, name) in enumerate(rows):
        assert got[i].layout == name
        assert got[i].turns is None if name is None else [(t.role, t.text) for t in got[i].turns] == [("user", "q"), ("assistant", "a")]
    assert got[99].turns is None and got[98].turns is None
    for r, name in rows[:-1]:
        table = spark.read.json(spark.sparkContext.parallelize([json.dumps(r | {"conv_id": 1})]))
        assert chat.select_mapping(table.schema).name == name
        assert [(t.role, t.text) for t in chat.to_turns(table).first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.select_mapping(spark.range(1).schema)


def test_records_with_more_fields(spark):
    """Fields that no mapping names don't count, an empty list is a conversation without turns, and each record's own layout is chosen."""
    said = [("user", "q"), ("assistant", "a")]
    rows = [
        ({"id": 3, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", said),
        ({"messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a", "weight": 1}]}, "messages", said),
        ({"prompt": "q", "completion": "a", "source": "web"}, "prompt_completion", said), ({"messages": []}, "messages", []),
        ({"prompt": "q", "response": "a", "messages": None, "score": 0.5}, "prompt_response", said), ({"instruction": "q", "input": "in", "output": "a", "question": "?"}, "instruction_input", [("user", "q\n\nin"), ("assistant", "a")]),
        ({"messages": [{"role": "human", "content": None}, {"role": "gpt"}]}, "messages", [("user", ""), ("assistant", "")]), ({"messages": "no list"}, None, None), ({"question": 7, "answer": True}, "question_answer", [("user", "7"), ("assistant", "true")]),
    ]
    got = {r.i: r for r in chat.json_turns(spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(rows)], "i int, j string"), "j").collect()}
    for i, (_, name, turns) in enumerate(rows):
        assert (got[i].layout, None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]) == (name, turns)
    other = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x")], "conv_id long, message_index int, role string, content string, text_id string")
    assert [(t.role, t.text) for t in chat.to_turns(other).first().turns] == said


# ---------------------------------------------------------------- secrets


def plain_secrets(text):
    out = []
    kinds = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    for k, (name, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [(k, s) for _, k, s in sorted(out)]


PARTS = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", " = ", ": ", "=", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 4, "abcdefgh", " ", "\n", "é", "K", "ſecret=abcdefgh", "ghp_" + "a" * 36]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_secret_spans(parts):
    text = "".join(parts)
    (found,) = secrets.scan(pa.array([text]), secrets.BASE + secrets.MORE)
    base = [(k, f"{secrets.BASE[k].kind}:{a}:{b}") for a, k, b in found if k < 3]
    assert base == plain_secrets(text)
    direct = sorted((a, k, b) for k, r in enumerate(secrets.BASE + secrets.MORE) for a, b in r.spans(text))
    assert found == direct


def test_trigram_queries():
    q = secrets.trigram_query
    assert q(r"AKIA[A-Z0-9]+") == ("and", frozenset({("tri", "aki"), ("tri", "kia")}))
    assert q(r"[0-9a-f]+") == secrets.ALL and q("a?b") == secrets.ALL
    assert q("abc|xyz") == ("or", frozenset({("tri", "abc"), ("tri", "xyz")}))
    assert q("(?:abc)*") == secrets.ALL and q("x.*abcd") == ("and", frozenset({("tri", "abc"), ("tri", "bcd")}))
    keyed = q(secrets.BASE[0].pattern)
    assert keyed != secrets.ALL
    assert secrets.Index(pa.array(["my PassWord: x", "apiKEY=", "passw ord", None, "pass", "word", "nothing"]), secrets.trigrams(keyed)).candidates(keyed).tolist() == [0, 1]


def test_postings_by_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbBcé ") for _ in range(rng.randrange(8))) for _ in range(400)] + [None, ""]
    asked = {"".join(rng.choice("abc ") for _ in range(3)) for _ in range(20)}
    for arr, own in ((pa.array(texts), texts), (pa.array(texts).slice(100, 200), texts[100:300])):
        index = secrets.Index(arr, asked)
        for t in asked:
            assert index.postings[t].tolist() == [i for i, x in enumerate(own) if t in (x or "").lower()]
    assert secrets.Index(pa.array(texts), {"abé"}).candidates(("tri", "abé")).tolist() == list(range(402))


def test_tokens_by_pattern():
    """The pivot finds what the pattern finds, and a hostile text of a megabyte takes no longer than others."""
    import time

    rule = next(r for r in secrets.MORE if r.kind == "jwt")
    rng = random.Random(6)
    parts = ["eyJ", "eyJabcdefgh", "abcdefgh", ".", ".eyJabcdefgh", " ", "eyJeyJ", "_-", ".abcdefgh9", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert rule.spans(text) == [m.span() for m in re.finditer(rule.pattern, text)]
    start = time.time()
    for text in ("eyJ" * 350_000 + ".eyJ", "eyJabcdefgh" * 90_000 + "." + "eyJabcdefgh", ".eyJabcdefgh" * 90_000, "eyJabcdefgh." * 90_000):
        secrets.scan(pa.array([text]), secrets.BASE + secrets.MORE)
    assert time.time() - start < 20


def test_secrets_query(spark, sf, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op4_secret_scans(spark, sf).collect():
        want = plain_secrets(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(s for _, s in want).encode()).hexdigest()


def test_redaction(spark):
    df = spark.createDataFrame([(1, 'x token = "abcdefgh12" y'), (2, None), (3, "clean")], "i int, text string")
    assert {r.i: r.text for r in secrets.redact(df).collect()} == {1: 'x [assign]" y', 2: None, 3: "clean"}


# ---------------------------------------------------------------- licenses


def plain_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(licenses.WORD, low)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
                score = 1.0
    for t in licenses.TEMPLATES:
        for line in low.split("\n"):
            share = len(t.tokens & set(re.findall(licenses.WORD, line))) / len(t.tokens)
            if share >= t.threshold:
                labels.add(t.label)
                score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def test_licenses_query_and_fixture(spark, sf, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    found = {r.doc_id: tuple(r)[1:] for r in queries.op5_license_scans(spark, sf).collect()}
    assert found == {i: plain_licenses(t or "") for i, t in texts.items()}
    rng = random.Random(0)
    pool = [w for t in licenses.TEMPLATES for w in licenses.words(t.text)] + ["cc", "by", "nc", "x", "\n", "MIT", "KelvinK", "é"]
    made = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(300)]
    made += [(1000 + i, "x " + t.text + "\ny") for i, t in enumerate(licenses.TEMPLATES)] + [(2000, "Under the\nMIT-License under_the mit license"), (2001, "CC BY-NC 4.0"), (2002, None)]
    got = {r.i: tuple(r)[1:] for r in licenses.find_licenses(spark.createDataFrame(made, "i int, text string"), ["i"]).collect()}
    assert got == {i: plain_licenses(t or "") for i, t in made}
    assert all(licenses.TEMPLATES[i].label in got[1000 + i][5].split(",") for i in range(len(licenses.TEMPLATES)))


def test_license_filters():
    """The join against plain containment on random blocks; the positional filter ends candidates that the other two let through."""
    rng = random.Random(2)
    frequency = {w: rng.randrange(50) for t in licenses.TEMPLATES for w in t.tokens}
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, frequency)
    index, rank = scanner.templates, scanner.rank
    by_position = 0
    for _ in range(3000):
        t = rng.choice(licenses.TEMPLATES)
        block = {rank[w] for w in sorted(t.tokens) if rng.random() < 0.85} | {rng.randrange(len(frequency)) for _ in range(rng.randrange(6))}
        want = {k: len(block & s.tokens) / len(s.order) for k, s in enumerate(index.sides) if len(block & s.tokens) >= s.need}
        assert dict(index.join(block)) == want
        loose = {k for k, s in enumerate(index.sides) if len(block) >= s.need and block & set(s.prefix)}
        assert set(index.candidates(sorted(block))) <= loose
        by_position += len(loose) - len(index.candidates(sorted(block)))
    assert by_position > 1000


def test_license_windows_are_in_order():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, {})
    for _ in range(200):
        side = rng.choice(scanner.templates.sides)
        a = [rng.choice(side.seq) for _ in range(rng.randrange(60))]
        assert licenses.in_order(a, side) == plain(a, side.seq)
    # words of licenses in disorder are read in a moment
    text = " ".join(rng.choice(licenses.words(licenses.TEMPLATES[10].text)) for _ in range(20_000))
    assert scanner.scan(text)[0] == 20_000


# ---------------------------------------------------------------- languages


def test_language_accuracy(spark, sf, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op9_language_id(spark, sf).collect()
    assert len(got) == len(langs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    texts = {"en": ["the quick brown fox and the lazy dog " * 5] * 4, "de": ["der schnelle braune fuchs und der faule hund " * 5] * 4}
    model = langid.train(texts)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "The Fox And The Dog"), (5, "der faule Hund"), (6, "漢字"), (7, "a")], "i int, text string")
    got = {r.i: r for r in langid.identify(df, model, ["i"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "en" and got[5].lang_pred == "de"
    assert got[6].lang_pred in texts and got[6].known < 0.1 and got[7].lang_pred in texts
    assert {r.lang_pred for r in langid.identify(df, langid.train({}), ["i"]).collect()} == {"und"}
    many = langid.train({f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}zq " * 30] for k in range(30)})
    one = spark.createDataFrame([("bbzq bbzq bbzq",)], "text string")
    assert langid.identify(one, many, []).first().lang_pred == "l27" and many.slices.shape[0] == 4


def test_scores_by_brute_force():
    """Bit-sliced popcounts against sets of n-grams, whole texts and slices of them alike."""
    rng = random.Random(8)
    texts = {k: [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)) for _ in range(5)] for k, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "vwxyz"))}
    model = langid.train(texts)
    arr = pa.array([*(x[0] for x in texts.values()), "", None, "abc", "VWX yz! " * 9, "é" * 30, " ".join(texts["aa"] + texts["cc"])])
    got = langid.scores(model, arr)
    s, table = model.settings, langid._letters()
    for i, text in enumerate(arr.to_pylist()):
        data = bytes(table[b] for b in (text or "").encode())
        grams = [data[j : j + s.n] for j in range(len(data) - s.n + 1)]
        grams = [g for g in grams if b"  " not in g]
        for k in range(3):
            code = [langid._slots(np.array([int.from_bytes(g, "little")], np.uint64), s) for g in grams]
            share = sum(all(model.slices[k // 8][x[0]] >> (k % 8) & 1 for x in slots) for slots in code) / max(1, len(grams))
            assert abs(got[i, k] - min(1, max(0, (share - model.fill[k]) / (1 - model.fill[k])))) < 1e-9
    assert all(np.allclose(langid.scores(model, arr, most), got) for most in (1, 7, 100)) and (langid.scores(model, arr.slice(2, 5)) == got[2:7]).all()


def test_letters_of_any_script():
    assert langid.has_letter("12 é") and not langid.has_letter("1²_ 漢"[:3]) and langid.has_letter("漢") and not langid.has_letter(None)


# ---------------------------------------------------------------- toxicity


def test_toxicity_accuracy(spark, sf, duck):
    big = sf.replace("sf0.01", "sf0.1")
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, big).collect()}
    import duckdb

    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{big}/labels.parquet'").fetchall()
    held = [(got[i].score, got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    s, p, y = (np.array(x) for x in zip(*held, strict=True))
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    # with 329 toxic texts to learn from; a word list had 0.9 of both, trained dictionaries reach 0.84 and 0.73 here
    assert auc > 0.95 and ((p == 1) & (y == 1)).sum() / (y == 1).sum() > 0.8 and (y[p == 1] == 1).mean() > 0.7
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def toxic_sample(n=80):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "ti", "re", "sho", "lu", "mi", "ker", "do"]) for _ in range(rng.randrange(1, 4)))
    plain = [" ".join(word() for _ in range(90)) for _ in range(2 * n)]
    return [x.replace(" ", " wretch ", 2).replace("an", "zounds", 1) for x in plain[:n]], plain[n:]


def test_dictionaries_are_trained_apart():
    toxic, ordinary = toxic_sample()
    m = toxicity.train(toxic, ordinary)
    assert not m.toxic.endswith(m.ordinary) and not m.ordinary.endswith(m.toxic) and len(m.toxic) < len(m.ordinary)
    assert b"wretch" in m.toxic and b"wretch" not in m.ordinary
    held = [toxicity.probability(m, x, 0.0) for x in ("mishoan luti wretch do", "mishoan luti kerdo do")]
    assert held[0] > 0.5 > held[1] and toxicity.probability(m, "", 0.0) < 0.5


def test_distances_by_brute_force():
    """Windows of a text one after the other, each compressed with both dictionaries by plain calls."""
    import zstandard

    toxic, ordinary = toxic_sample()
    m = toxicity.train(toxic, ordinary)
    w = re.findall(r"[^\W\d_]+", toxic[0].lower())
    how = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=7, min_match=4, strategy=zstandard.STRATEGY_LAZY2, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    want = []
    for a in range(0, len(w), m.settings.words):
        piece = f" {' '.join(w[a : a + m.settings.words])} ".encode() + toxicity.TAIL
        size = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(piece)) for d in (m.ordinary, m.toxic + m.ordinary)]
        want.append(max(0, size[0] - size[1]))
    distance = m.distances()
    assert [distance(x) for x in toxicity.windows(toxic[0], m.settings.words)] == want and max(want) >= 3
    beyond = [sum(d >= k for d in want) for k in range(1, m.settings.farthest + 1)]
    got = toxicity.features(m, toxic[0])
    assert got[2 : 2 + m.settings.farthest].round(9).tolist() == [round(math.log1p(n), 9) for n in beyond]


def test_samples_of_one_id(spark):
    """Rows with one (null) id are told apart by their texts, and repeated rows count once."""
    rows = [(None, f"{k} {'the house' if k % 2 else 'la maison'}", "en" if k % 2 else "fr") for k in range(3000)] + [(None, "copy", "en")] * 500
    got = common.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "doc_id", "text", 200)
    assert {k: len(v) for k, v in got.items()} == {"en": 200, "fr": 200} and all(len(set(v)) == 200 for v in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, fitted, ["doc_id"]).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, ones).prior == 1.0
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit(docs, both), ["doc_id"]).collect())


# ---------------------------------------------------------------- lines


def plain_dedup(docs, least):
    """Every pair of places is compared, runs extended both ways, and lines of long enough runs deleted at the later place."""
    lines = {i: [(p, s) for p, s in enumerate(t.split("\n")) if s.split()] for i, t in docs}
    gone = {i: set() for i, _ in docs}
    places = [(i, k) for i, _ in docs for k in range(len(lines[i]))]
    for a, (i, k) in enumerate(places):
        for j, m in places[:a]:
            if lines[i][k][1] != lines[j][m][1]:
                continue
            lo = hi = 0
            while k - lo - 1 >= 0 and m - lo - 1 >= 0 and lines[i][k - lo - 1][1] == lines[j][m - lo - 1][1]:
                lo += 1
            while k + hi + 1 < len(lines[i]) and m + hi + 1 < len(lines[j]) and lines[i][k + hi + 1][1] == lines[j][m + hi + 1][1]:
                hi += 1
            if sum(len(s.split()) for _, s in lines[i][k - lo : k + hi + 1]) >= least:
                gone[i] |= {p for p, _ in lines[i][k - lo : k + hi + 1]}
    return {i: ("\n".join(s for p, s in enumerate(t.split("\n")) if p not in gone[i]), len(gone[i])) for i, t in docs}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 1, 2, 3, 5]))) for _ in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(24)]
    docs += [(100 + i, docs[rng.randrange(24)][1]) for i in range(4)]
    for least in (1, 6):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df, least_words=least).collect()}
        assert got == plain_dedup(docs, least)


def test_line_dedup_keeps_passages_once(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    short = " ".join(f"s{i}" for i in range(49))
    docs = [(i, f"own line {i}\n{passage}\n{short} {'' if i else ' '}\nend {i}") for i in range(40)] + [(90, passage), (91, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert passage in got[0].text and all(passage not in got[i].text for i in range(1, 40)) and got[90].text == "" and got[91].text is None
    assert all(f"own line {i}" in got[i].text for i in range(40))


# ---------------------------------------------------------------- all of them on odd rows


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (7, 0)], "doc_id long, toxic int")
    for docs, n in ((edge_docs, 12), (empty_docs, 0)):
        model = langid.fit(docs)
        langs = langid.identify(docs, model, docs.columns).collect()
        assert len(langs) == n and all(r.text is None or isinstance(r.text, str) for r in langs)
        assert [r.lang_pred for r in langs if not langid.has_letter(r.text)] == ["und"] * sum(not langid.has_letter(r.text) for r in langs)
        assert secrets.find_secrets(docs, ["doc_id"]).count() == n and licenses.find_licenses(docs, ["doc_id", "labels"] if n else ["doc_id"]).count() == n
        assert toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).count() == n
        lines = linededup.dedup_lines(docs).collect()
        assert len(lines) == n and sum(r.text is None for r in lines) == (1 if n else 0)


def test_word_count(spark):
    texts = [None, "", "  ", "a", " a  b\tc\n\nd\r\n", "é\x0bß\x0c漢", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", common.word_count(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 0, 1, 4, 3, 1]


def test_licenses_as_published(spark):
    """Notices that wrap, with and without comment marks, and the short sentence of the GPL."""
    notices = {
        "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal"],
        "gpl": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by"],
        "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"],
        "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this"],
    }
    rows, want = [], {}
    for label, lines in notices.items():
        for mark in ("", " * ", "# ", "dnl "):
            want[len(rows)] = label
            rows.append((len(rows), "a first line of code\n" + "\n".join(mark + x for x in lines) + "\nand the rest"))
    want[len(rows)] = "gpl"
    rows.append((len(rows), "Some prose. This work is licensed under the GNU General Public License, version 3. More prose."))
    want[len(rows)] = ""
    rows.append((len(rows), ("\n" + "filler " * 40 + "\n").join(w for x in notices["bsd"] for w in x.split())))
    whole = {}
    for k, t in enumerate(licenses.TEMPLATES[10:19]):  # whole texts, ten words a line, behind comment marks
        w = t.text.split()
        whole[len(rows)] = t.label
        rows.append((len(rows), "code\n" + "\n".join((" * ", "# ", "// ")[k % 3] + " ".join(w[i : i + 10]) for i in range(0, len(w), 10)) + "\nmore code"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert all(label in got[i][0].split(",") for i, label in whole.items())  # one holds another's first sentence
    assert {i: got[i][0] for i in want} == want and all(got[i][1] >= 0.8 for i in want if want[i])
