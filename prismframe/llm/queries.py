"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm import chat, decontam, embdedup, langid, licenses, linededup, mixing, ngramjoin, secrets, toxicity
from prismframe.llm.common import id_remainder, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts: the table's turn rows, and a list of messages for the conversation that the contract adds."""
    more = spark.sql(
        r"""SELECT CAST(-7 AS BIGINT) AS conv_id, array(named_struct('role', 'user', 'content', r'</s>[INST] ok [/INST]'),
        named_struct('role', 'assistant', 'content', r'</s>[INST] ok [/INST]')) AS messages"""
    )
    layouts = table(spark, sf_dir, "conversations"), more
    turns = [chat.to_turns(df).select(F.col("conv_id").cast("long").alias("conv_id"), "turns") for df in layouts]
    return chat.digest(chat.read_back(chat.render(turns[0].unionByName(turns[1]))))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(s, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'),
    '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS e
  FROM (SELECT *, role || text AS s FROM rows)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(e) + length('<|im_start|><|im_sep|><|im_end|>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("d").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").cast("long").alias("start_word"), "similarity")


#: Leaks in {docs}: every window of an item's size, wherever it starts, is compared exactly, with shingles as text; no fingerprints. Of the best windows
#: the first that starts at a shingle of the item is named.
LEAKS_SQL = r"""
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), item_sh AS (
  SELECT DISTINCT item_id, len(w) AS n, array_to_string(w[i + 1 : i + 5], ' ') AS h
  FROM (SELECT *, unnest(range(len(w) - 4)) AS i FROM item_words WHERE len(w) >= 5)
), weights AS (SELECT h, 1.0::DOUBLE / count(DISTINCT item_id) AS weight FROM item_sh GROUP BY h),
item_w AS (SELECT item_id, n, h, weight, sum(weight) OVER (PARTITION BY item_id) AS total FROM item_sh JOIN weights USING (h)),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {docs} WHERE text IS NOT NULL
), doc_sh AS (
  SELECT doc_id, i AS pos, array_to_string(w[i + 1 : i + 5], ' ') AS h FROM (SELECT *, unnest(range(len(w) - 4)) AS i FROM doc_words WHERE len(w) >= 5)
), hits AS (
  SELECT doc_id, item_id, n, pos, h, weight, total FROM doc_sh JOIN item_w USING (h)
), held AS (
  SELECT DISTINCT doc_id, item_id, h, weight, total, unnest(range(greatest(0, pos - n + 5), pos + 1)) AS start FROM hits
), sims AS (
  SELECT doc_id, item_id, start, round(sum(weight) / max(total), 6) AS similarity FROM held GROUP BY doc_id, item_id, start
), best AS (
  SELECT doc_id, item_id, max(similarity) AS similarity FROM sims GROUP BY doc_id, item_id
), leaks AS (
  SELECT doc_id, item_id, min(start)::BIGINT AS start_word, similarity
  FROM best JOIN sims USING (doc_id, item_id, similarity) JOIN (SELECT DISTINCT doc_id, item_id, pos AS start FROM hits) USING (doc_id, item_id, start)
  WHERE similarity >= 0.8 GROUP BY doc_id, item_id, similarity
)"""

OP2_SQL = "WITH " + LEAKS_SQL.format(docs="documents") + "\nSELECT * FROM leaks"


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = mixing.mix(table(spark, sf_dir, "documents"))
    return read.select(F.col("d").alias("doc_id"), "source", F.col("epoch").cast("long").alias("epoch"), "block", "slot", "tokens")


#: The mix of {docs}: the exponent is bisected by a recursive query over its steps of 1e-6.
MIX_SQL = r"""
tok AS (
  SELECT doc_id, coalesce(source, '') AS source,
    len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> ''))::BIGINT AS tokens
  FROM {docs} WHERE text IS NOT NULL
), src AS (SELECT source, sum(tokens)::BIGINT AS whole FROM tok WHERE tokens > 0 GROUP BY source),
tot AS (SELECT sum(whole)::BIGINT AS total, count(*) AS n FROM src),
search AS (
  WITH RECURSIVE e(lo, hi) AS (
    SELECT 0, 1000001
    UNION ALL
    SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
      SELECT lo, hi, (lo + hi) // 2 AS mid, (SELECT n = 1 OR round(-sum(p * ln(p)) / ln(max(n)), 12) >= 0.95 FROM (
        SELECT pow(whole / total, ((lo + hi) // 2) / 1000000) / sum(pow(whole / total, ((lo + hi) // 2) / 1000000)) OVER () AS p, n FROM src, tot) GROUP BY n) AS ok
      FROM e WHERE hi - lo > 1))
  SELECT max(lo) AS even FROM e
), search2 AS (
  WITH RECURSIVE e(lo, hi) AS (
    SELECT 0, 1000001
    UNION ALL
    SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
      SELECT lo, hi, (lo + hi) // 2 AS mid, (SELECT max(p * total / whole) > 4 + 1e-9 FROM (
        SELECT pow(whole / total, ((lo + hi) // 2) / 1000000) / sum(pow(whole / total, ((lo + hi) // 2) / 1000000)) OVER () AS p, total, whole FROM src, tot)) AS ok
      FROM e WHERE hi - lo > 1))
  SELECT max(lo) + 1 AS least FROM e
), chosen AS (
  SELECT least(1000000, greatest(even, CASE WHEN (SELECT max(total / n / whole) > 4 + 1e-9 FROM src, tot) THEN least ELSE 0 END)) / 1000000 AS a FROM search, search2
), quota AS (
  SELECT source, whole, floor(round(pow(whole / total, a) / sum(pow(whole / total, a)) OVER (), 12) * total)::BIGINT AS quota, greatest(1, ceil(total / 250000))::BIGINT AS blocks
  FROM src, tot, chosen
), copies AS (
  SELECT t.*, whole, quota, blocks, unnest(range(1, ceil(quota / whole)::BIGINT + 1)) AS epoch FROM tok t JOIN quota USING (source) WHERE tokens > 0
), keyed AS (
  SELECT *, ('0x' || substr(md5('7|' || epoch || '|' || doc_id), 1, 15))::BIGINT AS key, ('0x' || substr(md5('7|slot' || epoch || '|' || doc_id), 1, 15))::BIGINT AS slot FROM copies
), placed AS (
  SELECT *, (epoch - 1) * whole + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM keyed
), mixed AS (
  SELECT doc_id, source, epoch, least(blocks - 1, floor((stop - tokens)::DOUBLE / quota * blocks))::BIGINT AS block, slot, tokens FROM placed WHERE stop <= quota
)"""

OP3_SQL = "WITH " + MIX_SQL.format(docs="documents") + "\nSELECT * FROM mixed"


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(k: int, rule: secrets.Rule) -> str:
    """Rows (doc_id, k, kind, a, b): a match's place is the length of all pieces and matches before it."""
    p = _quoted(rule.pattern)
    return f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a,
    length(found[i]) AS n, length(counted[i]) AS counted, {rule.least} AS least
  FROM (SELECT doc_id, pieces, found, counted, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(text, {p}) AS pieces, regexp_extract_all(text, {p}, 0) AS found, regexp_extract_all(text, {p}, {rule.group}) AS counted FROM documents))"""


OP4_SQL = f"""WITH m AS ({" UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(secrets.BASE + secrets.MORE))}
), s AS (SELECT doc_id, k, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM m WHERE counted >= least
), g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))},
    string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(secrets.BASE)}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), w AS (SELECT doc_id, {_WORDS.format("x")} AS w FROM d),
phrases(phrase, label) AS (VALUES {", ".join(f"(string_split({_quoted(p)}, ' '), {_quoted(label)})" for p, label in licenses.PHRASES)}),
places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, label, phrase, unnest(range(len(w) - len(phrase) + 1)) AS i FROM w, phrases) WHERE w[i + 1 : i + len(phrase)] = phrase
), base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
templates(t, label, least, body) AS (VALUES {", ".join(f"({i}, {_quoted(t.label)}, {t.threshold}, {_quoted(t.text.lower())})" for i, t in enumerate(licenses.TEMPLATES))}),
tokens AS (SELECT t, label, least, unnest(list_distinct({_WORDS.format("body")})) AS token FROM templates),
sizes AS (SELECT t, count(*) AS n FROM tokens GROUP BY t),
lines AS (SELECT doc_id, line, unnest(list_distinct({_WORDS.format("body")})) AS token FROM (
  SELECT doc_id, unnest(string_split(x, chr(10))) AS body, unnest(range(len(string_split(x, chr(10))))) AS line FROM d)),
met AS (SELECT doc_id, label, max(share) AS share FROM (
  SELECT doc_id, line, t, label, least, count(*)::DOUBLE / max(n) AS share FROM lines JOIN tokens USING (token) JOIN sizes USING (t) GROUP BY doc_id, line, t, label, least)
  WHERE share >= least::DOUBLE GROUP BY doc_id, label),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM places UNION ALL SELECT doc_id, label, share FROM met),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 4) != 2))
    found = toxicity.score(docs, fitted, ["doc_id"])
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The lines of a text that an earlier place repeats, for {docs} with doc_id and text; lines are compared as they are, not by hash.
LINES_SQL = r"""
lines AS (
  SELECT doc_id, pos, line, len(list_filter(string_split(translate(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs} WHERE text IS NOT NULL)
), counted AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS after, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS before FROM lines WHERE words > 0
), spans AS (
  SELECT doc_id, pos, before, after,
    list(line) OVER f AS f_run, max(after) OVER f AS f_after, max(pos) OVER f AS f_end,
    list(line) OVER b AS b_run, min(before) OVER b AS b_before, min(pos) OVER b AS b_start
  FROM counted
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
    b AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), runs AS (
  SELECT doc_id, pos AS s, f_end AS e, f_run AS run FROM spans WHERE f_after - before >= 50
  UNION ALL SELECT doc_id, b_start, pos, b_run FROM spans WHERE after - b_before >= 50
), firsts AS (SELECT run, min((doc_id, s)) AS first FROM runs GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM runs JOIN firsts USING (run) WHERE (doc_id, s) > first
), cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g IS NULL), '') AS text, count(*) AS n_lines, count(g) AS n_removed
  FROM (SELECT l.*, CASE WHEN words > 0 THEN gone.pos END AS g FROM lines l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos) GROUP BY doc_id
)"""

OP7_SQL = (
    "WITH "
    + LINES_SQL.format(docs="documents")
    + """
SELECT d.doc_id, c.text, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)"""
)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents")).drop("t").withColumnRenamed("d", "doc_id")


#: All pairs that share a shingle are compared, and groups are found by reachability.
OP8_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS h FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * k >= 4 * (x.n + y.n)),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, b FROM reach JOIN link ON a = r)
SELECT v AS doc_id, min(r) AS class_id, (SELECT count(*) FROM link WHERE a = v)::BIGINT AS n_links, min(r) = v AS kept FROM reach GROUP BY v"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(id_remainder("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "known")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.dedup(table(spark, sf_dir, "embeddings"))


OP10_SQL = """WITH RECURSIVE x AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM x WHERE list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT v, b FROM reach JOIN link ON a = r)
SELECT v AS vec_id, min(r) AS component_id, (SELECT count(*) FROM link WHERE a = v)::BIGINT AS n_links, min(r) = v AS kept FROM reach GROUP BY v"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_mixing": OP3_SQL, "op4_secret_scans": OP4_SQL, "op5_license_scans": OP5_SQL,
        "op7_line_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op10_embedding_dedup": OP10_SQL,
    }
