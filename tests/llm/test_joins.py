"""Joins, mixes, graphs and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.llm import common, components, decontam, embdedup, langid, mixing, ngramjoin

import corpus_pipeline


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(sets, threshold=0.8):
    """For each id its smallest linked id and its number of links."""
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = sets[i], sets[j]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-12:
                links[i].add(j)
                links[j].add(i)
    label = {}
    for i in ids:
        if i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += links[k]
    return {i: (label[i], len(links[i])) for i in ids}


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    docs = [[word() for _ in range(rng.choice([3, 8, 30, 60, 120]))] for _ in range(n)]
    common_part = [word() for _ in range(30)]
    for base in range(0, n, 6):
        for _ in range(rng.randrange(5)):
            new = list(docs[base])
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = word()
            docs.append(new)
    docs += [common_part + [word() for _ in range(60)] for _ in range(70)]  # a passage that many share
    near = [word() for _ in range(200)]
    for _ in range(90):  # a group of near copies that no shared token can split
        new = list(near)
        new[rng.randrange(200)] = word()
        docs.append(new)
    docs += [docs[3], docs[3], docs[7]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_join_by_brute_force(spark):
    docs = corpus()
    want = groups({i: shingles(t) for i, t in docs})
    s = ngramjoin.Settings(limit=8, block=16, depth=3)
    df = spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "  ")], "doc_id long, text string")
    got = {r.d: (r.class_id, r.n_links, r.kept) for r in ngramjoin.join(df, s=s).collect()}
    assert {i: v[:2] for i, v in got.items() if i < 9000} == want
    assert all(got[i] == (i, 0, True) for i in (9000, 9001, 9002))
    assert sum(v[2] for v in got.values()) == len({v[0] for v in got.values()})


def test_shingle_sets_are_those_of_words():
    import pyarrow as pa

    texts = [None, "", "a", "a b c d e", "A  b\tc\nd e f", "a b c d e f", "é ß 漢 字 x y", " lead and trail of words here "]
    got = ngramjoin.shingle_sets(pa.array(texts))
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]
    assert set(got[3]) < set(got[5]) and (got[4] == got[5]).all()
    sliced = ngramjoin.shingle_sets(pa.array(texts).slice(3, 3))
    assert all((a == b).all() for a, b in zip(sliced, got[3:6], strict=True))


def test_runs_follow_from_the_recall():
    s = ngramjoin.Settings()
    assert (1 - 0.8**s.depth) ** s.runs <= 1 - s.recall < (1 - 0.8**s.depth) ** (s.runs - 1)


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for cells in (1 << 22, 64):
        got = ngramjoin.intersections(sets, cells)
        assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)


def test_components(spark):
    edges = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(30)] + [(b"100", b"102"), (b"102", b"101")]
    got = {bytes(r.v): bytes(r.label) for r in components.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(got[b"%03d" % i] == b"000" for i in range(31)) and {got[b"%d" % i] for i in (100, 101, 102)} == {b"100"}
    assert components.components(spark.createDataFrame([(b"a", b"a")], "a binary, b binary")).count() == 0


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    rng = random.Random(0)
    word = lambda: f"w{rng.randrange(300)}"
    items = [[word() for _ in range(rng.randrange(15, 50))] for _ in range(20)] + [["too", "short"]]
    docs, planted = [], {}
    for i in range(120):
        body = [word() for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            k = rng.randrange(20)
            at = rng.randrange(len(body))
            body[at:at] = items[k]
            planted[i] = k
        if i % 4 == 1:
            k = rng.randrange(20)
            body[5:5] = items[k][: len(items[k]) // 2]
        docs.append((i, ", ".join(body).upper() if i % 3 else " ".join(body)))
    docs += [(500, "  " + " ".join(items[0]) + "!"), (501, None), (502, ""), (503, "too short"), (504, " ".join(items[1][:-2]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(77, None)], "item_id long, text string")
    got = {(r.d, r["item"]): r.similarity for r in decontam.find_leaks(df, bench).collect()}
    assert {(i, k) for i, k in planted.items()} <= set(got) and (500, 0) in got and got[500, 0] == 1.0 and (504, 1) in got
    assert all(i in planted or i in (500, 504) for i, _ in got)


def leaks_by_sql(docs, items):
    import duckdb

    from prismframe.llm import queries

    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return {(d, i): (at, s) for d, i, at, s in con.execute(f"SELECT doc_id, item_id, start_word, similarity FROM ({queries.OP2_SQL})").fetchall()}


def found_leaks(spark, docs, items):
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.d, r["item"]): (r.start, r.similarity) for r in got.collect()}


def test_index_meets_all_pairs_within_the_radius(spark):
    rng = random.Random(0)
    items = [(i, 9, [rng.getrandbits(63) for _ in range(decontam.LONGS)]) for i in range(60)]
    prints, want = [], set()
    for w in range(600):
        i, _, g = rng.choice(items)
        f, far = list(g), rng.choice([0, 1, 40, decontam.RADIUS, decontam.RADIUS, decontam.RADIUS + 1, 90])
        for bit in rng.sample(range(decontam.BITS), far):
            f[bit // 63] ^= 1 << (bit % 63)
        prints.append((w, 9 if w % 7 else 8, f))
    for w, n, f in prints:
        want |= {(w, i) for i, m, g in items if m == n and sum((a ^ b).bit_count() for a, b in zip(f, g, strict=True)) <= decontam.RADIUS}
    got = decontam.within(spark.createDataFrame(prints, "w long, n int, f array<long>"), spark.createDataFrame(items, "i long, n int, g array<long>")).collect()
    assert len(got) == len(want) > 300 and {(r.w, r.i) for r in got} == want


def test_fingerprints_are_simhashes(spark):
    rng = random.Random(1)
    rows = [(k, [(rng.getrandbits(63), 1 / rng.choice([1, 2, 50])) for _ in range(rng.choice([1, 5, 60]))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, parts array<struct<h:long,w:double>>")
    flat = df.select("k", F.explode("parts").alias("p")).select("k", "p.w", *(F.xxhash64("p.h", F.lit(j)).alias(f"x{j}") for j in range(decontam.LONGS))).collect()
    for r in df.select("k", decontam.fingerprint("parts").alias("f")).collect():
        own = [x for x in flat if x.k == r.k]
        for j in range(decontam.LONGS):
            for b in range(63):
                bal = sum((1 if (x[f"x{j}"] >> b) & 1 else -1) * x.w**0.5 for x in own)
                assert abs(bal) < 0.01 * len(own) or ((r.f[j] >> b) & 1) == (bal > 0)


def test_leaks_of_items_that_share_boilerplate(spark):
    """The item's own passage among words that differ from the shared ones: similar by weight, far apart by the number of shingles."""
    for n_items, n_shared, n_own in ((50, 64, 30), (40, 60, 30), (40, 30, 30), (40, 80, 8)):
        rng = random.Random(n_shared)
        word = lambda: f"w{rng.randrange(10**6)}"
        shared = [word() for _ in range(n_shared)]
        items = [(k, " ".join([word() for _ in range(n_own)] + shared)) for k in range(n_items)]
        docs = [(k, " ".join([word() for _ in range(6)] + x.split()[:n_own] + [word() for _ in range(n_shared)])) for k, x in items]
        # and beside the shared part as it is, of which no item is leaked
        docs.append((900, " ".join(shared + [word() for _ in range(40)])))
        want = leaks_by_sql(docs, items)
        assert {d for d, _ in want} == (set(range(n_items)) if n_own > 8 else set()) and found_leaks(spark, docs, items) == want


def test_leaks_of_windows_that_no_shingle_aligns(spark):
    """Words put into the middle of a passage: no window that is aligned with the item is the best one."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(k, [word() for _ in range(46)]) for k in range(20)]
    docs = [(k, " ".join([word() for _ in range(9)] + x[:22] + [word(), word()] + x[22:] + [word() for _ in range(9)])) for k, x in items]
    items = [(k, " ".join(x)) for k, x in items]
    want = leaks_by_sql(docs, items)
    assert len(want) == 20 and found_leaks(spark, docs, items) == want


def test_recall_of_leaks_near_the_threshold(spark):
    """Items of one size, with weights from 1 to 1/40, leaked in part, one beside the other, and in any order of their halves."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    pool = [[word() for _ in range(14)] for _ in range(6)]
    items = [(k, sum(([word() for _ in range(12)] + rng.choice(pool) if rng.random() < 0.5 else [word() for _ in range(26)] for _ in range(2)), [])) for k in range(240)]
    docs = []
    for k in range(1200):
        body = [word() for _ in range(5)]
        for _ in range(rng.choice([1, 1, 2])):
            x = list(rng.choice(items)[1])
            at, n = rng.randrange(len(x)), rng.randrange(0, 9)
            x = x[26:] + x[:26] if rng.random() < 0.3 else x[n:] if rng.random() < 0.5 else x[:at] + [word()] + x[at + 1 :]
            body += x
        docs.append((k, " ".join(body + [word() for _ in range(5)])))
    items = [(k, " ".join(x)) for k, x in items]
    want, got = leaks_by_sql(docs, items), found_leaks(spark, docs, items)
    close = [p for p, v in want.items() if v[1] < 0.9]
    recall = sum(p in got for p in want) / len(want)
    print(f"{len(want)} leaks, recall {recall:.4f}; {len(close)} of them below 0.9, recall {sum(p in got for p in close) / len(close):.4f}")
    assert len(close) > 300 and recall >= 0.99 and sum(p in got for p in close) / len(close) >= 0.99
    assert set(got) <= set(want) and sum(got[p][1] == want[p][1] for p in got) >= 0.99 * len(got)


def test_leaks_of_edges(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([(1, "hello world of words again"), (1, "text without an id at all here"), (2, None)], "item_id long, text string")
    got = decontam.find_leaks(edge_docs, bench).collect()
    assert [(r.d, r["item"]) for r in got] == [(None, 1)]
    assert decontam.find_leaks(empty_docs, bench).count() == 0 and decontam.find_leaks(edge_docs, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


def test_weights():
    t = {"a": 1000, "b": 100, "c": 10, "d": 0}
    a, p, budget = mixing.weights(t, mixing.Settings(entropy=0.0))
    assert a == 1.0 and budget == 1110 and abs(p["a"] - 1000 / 1110) < 1e-9
    a, p, _ = mixing.weights(t, mixing.Settings(entropy=0.8, repeats=1e9))
    assert abs(mixing.evenness(list(p.values())) - 0.8) < 1e-4
    a, p, budget = mixing.weights(t, mixing.Settings(entropy=1.0, repeats=4))
    assert max(p[k] * budget / t[k] for k in p) <= 4.0001 and abs(p["c"] * budget / 10 - 4) < 0.01
    assert mixing.weights({}, mixing.Settings()) == (1.0, {}, 0)
    with pytest.raises(ValueError):
        mixing.weights({"a": 10}, mixing.Settings(budget=100))


def test_mix_meets_its_budget(spark):
    rows = [(i, "w " * (1 + i % 9), "big" if i < 900 else "small") for i in range(1000)]
    s = mixing.Settings(entropy=1.0, repeats=3, block_tokens=500, range_rows=16)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), s=s).collect()
    tokens = {k: sum(1 + i % 9 for i, _, c in rows if c == k) for k in ("big", "small")}
    _, p, budget = mixing.weights(tokens, s)
    for k in p:
        own = [r for r in got if r.source == k]
        assert 0 <= p[k] * budget - sum(r.tokens for r in own) < 20
        per = {}
        for r in own:
            per[r.block] = per.get(r.block, 0) + r.tokens
        mean = sum(per.values()) / len(per)
        assert all(abs(v - mean) <= 20 for v in per.values())
        reads = {}
        for r in own:
            reads.setdefault(r.d, set()).add(r.epoch)
        assert all(e == set(range(1, max(e) + 1)) or max(e) == max(x.epoch for x in own) for e in reads.values())


def test_repeated_rows_are_read_once(spark):
    rows = [(i, f"{i} " + "w " * 9, "a", "x", 7) for i in range(20)] + [(i, f"{i} " + "w " * 9, "a", "y", 8) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __t string, epoch int")
    s = mixing.Settings(entropy=0.0)
    got = mixing.mixed_documents(df, s=s).collect()
    assert len(got) == mixing.mix(df, s=s).count() == 20 and {r.doc_id for r in got} == set(range(20))
    assert all(r["__t"] in "xy" and r.input_epoch in (7, 8) and r.epoch == 1 for r in got)


def test_mix_edges(spark, edge_docs, empty_docs):
    assert mixing.mix(empty_docs).count() == 0
    got = mixing.mixed_documents(edge_docs)
    assert got.filter("text IS NULL OR text = ''").count() == 0 and set(edge_docs.columns) <= set(got.columns)


# ---------------------------------------------------------------- embeddings


def test_graph_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    for k in range(40):
        x[200 + 5 * k : 205 + 5 * k] = x[k] + rng.normal(size=(5, 24)) * 0.06
    x[1000:1400] = x[999] + rng.normal(size=(400, 24)) * 0.05  # a large group of near copies
    x[1400:1420] = x[1] * np.arange(1, 21)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] + [1.0] * 23), (3003, [float("inf")] * 24), (3004, [None] + [1.0] * 23), (3005, []), (3006, [1.0]), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "u", "d", "shard", "label")})
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    for s in (embdedup.Settings(shard=300), embdedup.Settings(shard=300, block=128)):
        found = embdedup.dedup(df, s=s).collect()
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
        assert len(found) == 1508 and sum(r.vec_id == 0 for r in found) == 2  # one row is there twice: each is the other's link
        near[0, 0] = True
        for j in np.flatnonzero(near[0]).tolist():
            if j:
                got[j] = (got[j][0] - 1, *got[j][1:])
        assert len(got) == 1507 and all(got[i] == (0, i, True) for i in range(3000, 3007))
        assert all(got[i][0] <= near[i].sum() for i in range(1500))
        assert sum(got[i][0] for i in range(1500)) >= 0.98 * near.sum()
        assert sum(v[2] for v in got.values()) == len({v[1] for v in got.values()})


def links_and_labels(x, least=0.95):
    """For each row its number of links, and the smallest row of its component."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while (new := np.array([min(label[i], label[near[i]].min(initial=len(x))) for i in range(len(x))])).tolist() != label.tolist():
        label = new
    return near.sum(1), label


def test_a_large_group_is_not_cut_up_among_its_centroids(spark):
    """A third of all rows are distinct near copies, and so a third of the centroids are theirs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1800, 64))
    x[600:1200] = x[600] + rng.normal(size=(600, 64)) * 0.15
    links, label = links_and_labels(x)
    assert links[600:1200].min() >= 590
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for s in (embdedup.Settings(shard=9), embdedup.Settings(shard=9, block=128)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.dedup(df, s=s).collect()}
        assert got == {i: (links[i], label[i]) for i in range(1800)}


def test_rows_are_compared_outright_if_shards_miss_links(spark):
    """Links across the borders of shards, one shard a vector: the audit after the last overlap fails, and every link is found all the same."""
    rng = np.random.default_rng(4)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 700))
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    links, label = links_and_labels(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.dedup(df, s=embdedup.Settings(shard=70, block=256, overlap=1, most_overlap=1)).collect()}
    assert got == {i: (links[i], label[i]) for i in range(700)}


def test_vectors_of_every_length(spark):
    """Three lengths, one of them of few vectors: each is compared by itself, against brute force; zeros at the end don't make two lengths one."""
    rng = np.random.default_rng(6)
    rows, want, at = [], {}, 0
    for size, n in ((3, 40), (8, 300), (12, 260)):
        x = rng.normal(size=(n, size))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, size)) * 0.05
        links, label = links_and_labels(x)
        want |= {at + i: (links[i], at + label[i]) for i in range(n)}
        rows += [(at + i, v.tolist()) for i, v in enumerate(x)]
        at += n
    rows.append((at, [*rows[0][1], 0.0]))
    want[at] = (0, at)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embdedup.dedup(df, s=embdedup.Settings(shard=60, block=128)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)


def test_audit_asks_vectors_with_links(spark):
    """Links are so rare that vectors drawn from all have none: a half of each pair's links is missing, and the audit sees it."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 16))
    x[3:6] = x[0] + rng.normal(size=(3, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(bytes([i % 256, i // 256]), v.tolist(), 1) for i, v in enumerate(x)], "v binary, u array<double>, weight long")
    s = embdedup.Settings(audit=4)
    counts = lambda k: spark.createDataFrame([(bytes([i, 0]), k) for i in (0, 3, 4, 5)], "v binary, links long")
    assert embdedup.audit(rows, counts(3), 4000, s) == 1.0 and embdedup.audit(rows, counts(1), 4000, s) < 0.5


def test_copies_of_vectors_are_one_class(spark):
    """Copies by the thousand, and scaled ones: counted, never paired."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[3].tolist()) for i in range(3000)] + [(5000, (x[3] * 2).tolist()), (5001, (x[3] + rng.normal(size=8) * 0.01).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (3002, 3) for i in [3, 5000, 5001, *range(100, 3100)])


def test_graph_recall_on_the_table(spark, sf):
    from prismframe.llm import queries

    assert queries.op10_embedding_dedup(spark, sf).count() == 500
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embdedup.dedup(empty).count() == 0
    assert embdedup.dedup(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).count() == 2


def test_robust_pruning_keeps_the_nearest():
    x = embdedup.unit([v / np.linalg.norm(v) for v in np.random.default_rng(0).normal(size=(200, 8))])
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    lists = embdedup.robust_prune(x, embdedup.Settings())
    assert all(cos[i].argmax() in lists[i] and i not in lists[i] and len(lists[i]) <= 20 for i in range(200))
    assert len(embdedup.robust_prune(x[:1], embdedup.Settings())[0]) == 0


# ---------------------------------------------------------------- the join's and the pipeline's edges


def test_join_edges(spark, edge_docs, empty_docs):
    got = ngramjoin.join(edge_docs).collect()
    assert len(got) == 11  # one of the repeated rows
    by = {(r.d, r.n_links) for r in got}
    assert (1, 1) in by and (5, 1) in by and (7, 1) in by and (8, 1) in by
    assert ngramjoin.join(empty_docs).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Columns named like those of the operators, a table without n_chars, short texts, null ids, and an empty table."""
    names = ["score", "known", "lang_pred", "n_lines", "n_removed", "__gone", "__new", "__d", "__t", "__k", "d", "t", "epoch", "block", "slot", "copies", "kept"]
    prose = ["the river and the stone under the house " * 4, "a green paper of the seven nights and music " * 5, "Re.", "light under the table and the music of the night " * 5]
    rows = [(None if i == 1 else i, x, "en", "s") for i, x in enumerate(prose)]
    path = str(tmp_path)
    spark.createDataFrame([(0, "nothing of the kind stands in any of these documents")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, given = given.columns, common.written(stage(spark, given, path))
            if name != "mixing":
                assert given.columns == before
        got = given.collect()
        assert all(r[f"input_{n}" if n in ("epoch", "block", "slot") else n] == k for r in got for k, n in enumerate(names))
    assert given.columns[-3:] == ["epoch", "block", "slot"]
    assert sorted(r.text for r in common.written(corpus_pipeline.STAGES[0][1](spark, docs, path)).collect()) == sorted(prose)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version of what it decides, on a small corpus with cases of each kind."""
    from tests.llm.test_text_operators import plain_dedup

    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "and", "river", "stone", "light", "under", "house", "green", "paper", "seven", "night", "music", "table"]) + rng.choice(["", "s", "ed", "ing", "ly", "er"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(5)]
    docs = [(i, "\n".join(text(rng.randrange(20, 70)) for _ in range(3)), "en", f"s{i % 3}") for i in range(60)]
    passage = text(60)
    docs += [(100 + i, f"{text(40)}\n{passage}\n{text(45)}", "en", "s0") for i in range(5)]
    near = text(300).split()
    for i in range(6):
        copy = list(near)
        copy[50 * i + 3] = "changed"
        docs.append((200 + i, " ".join(copy), "en", "s1"))
    docs += [(300 + i, f"{text(50)} {items[i]} {text(20)}", "en", "s2") for i in range(5)]
    docs += [(400, "12 34", "en", "s0"), (401, None, None, "s0"), (402, "", "en", "s1"), (403, docs[0][1], "en", "s2")]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    given = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = given
        given = common.written(stage(spark, given, path))
        if name != "mixing":
            assert given.columns == at[name].columns and given.dtypes == at[name].dtypes
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    after = {n: texts(d) for n, d in at.items()}
    assert set(after["line_dedup"]) == {r[0] for r in rows if langid.has_letter(r[1])}
    plain = plain_dedup(sorted(after["line_dedup"].items()), 50)
    assert after["ngram_join"] == {i: t for i, (t, n) in plain.items() if not n or t.split()}
    assert all(r.n_chars == len(r.text) for r in at["ngram_join"].collect())
    want = groups({i: shingles(t) for i, t in after["ngram_join"].items()})
    assert set(after["decontamination"]) == {i for i, (label, _) in want.items() if label == i}
    leaked = {i for i, t in after["decontamination"].items() if any(x in " ".join(t.split()) for x in items)}
    assert set(after["mixing"]) == set(after["decontamination"]) - leaked and {300, 301, 302, 303, 304} <= leaked
    s = mixing.Settings()
    tokens = {}
    for r in at["mixing"].collect():
        tokens[r.source] = tokens.get(r.source, 0) + len(r.text.split())
    _, p, budget = mixing.weights(tokens, s)
    for k in p:
        read = sum(len(r.text.split()) for r in given.filter(F.col("source") == k).collect())
        assert 0 <= p[k] * budget - read < 400
