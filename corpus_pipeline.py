"""Documents to a training mix, in five stages; every stage reads what the one before has written.

Defined results, in every stage: columns beside ``doc_id text lang source n_chars`` pass through as they are, whatever they are called; rows equal
in id and text are one document from the third stage on; null ids and ids that repeat are told apart by their texts; texts of any length are
read whole; an empty table gives an empty one; a table without ``n_chars`` stays without.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm import common, decontam, langid, linededup, mixing, ngramjoin

STANDARD = ("doc_id", "text", "lang", "source", "n_chars")
#: A document of which a smaller share of n-grams is in any language is in none of them. The least share seen in real text is over 0.6.
LEAST_KNOWN = 0.25
#: A text of fewer bytes has too few n-grams to be judged by that share.
LEAST_BYTES = 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def extras_aside(stage: Stage) -> Stage:
    """The stage with all but the standard columns under names that no operator uses, and named as before after it."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"__extra {i}" for i, c in enumerate(docs.columns) if c not in STANDARD}
        out = stage(spark, docs.toDF(*(aside.get(c, c) for c in docs.columns)), sf_dir)
        back = {v: k for k, v in aside.items()}
        made = {c for c in out.columns if c not in back}
        return out.toDF(*(f"input_{back[c]}" if back.get(c) in made else back.get(c, c) for c in out.columns))

    return run_stage



def _row(d: Column, t: Column) -> Column:
    return F.xxhash64(d, t)


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents that are (left_semi) or are not (left_anti) among rows (d, t), one for rows equal in id and text."""
    t = F.xxhash64("text")
    keyed = docs.withColumns({"__t": t, "__k": _row(F.col("doc_id"), t)})
    rows = rows.select(F.col("d").alias("__d"), F.col("t").alias("__u"), _row(F.col("d"), F.col("t")).alias("__m"))
    same = (F.col("__k") == F.col("__m")) & (F.col("__t") == F.col("__u")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    return keyed.join(rows, same, how).dropDuplicates(["__k", "__t"]).select(*docs.columns)


@extras_aside
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those in none of the learned languages; short ones with a letter stay.

    Where no row has a language, nothing is learned and every document goes. Repeated rows stay as they are.
    """
    found = langid.identify(docs, langid.fit(docs), docs.columns)
    judged = (F.col("known") >= LEAST_KNOWN) | (F.octet_length("text") < LEAST_BYTES)
    return found.filter((F.col("lang_pred") != langid.UND) & judged).select(*docs.columns)


@extras_aside
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of lines out, with ``n_chars`` counted anew; a document of which nothing is left goes, others stay (null texts too)."""
    rows = linededup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (common.word_count(F.col("text")) > 0))
    if "n_chars" not in docs.columns:
        return rows.select(*docs.columns)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


@extras_aside
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id; documents without words are alone and stay."""
    return _matched(docs, ngramjoin.join(docs).filter("kept"), "left_semi")


@extras_aside
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item; null texts and an empty benchmark leak nothing."""
    leaks = common.written(decontam.find_leaks(docs, common.table(spark, sf_dir, "benchmark")).select("d", "t").distinct())
    return _matched(docs, leaks, "left_anti")


@extras_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is read, with its ``epoch``, ``block`` and place in the block (``slot``).

    Input columns of these names become ``input_<name>``. Documents without words are left out; a null source is one source.
    """
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

#: The Bloom filters of the first stage and the groups of the third one can't be written in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
