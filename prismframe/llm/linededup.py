"""Line dedup: winnowing over line hashes finds where runs of lines repeat; later repeats of a run are deleted. Native.

A line that is not blank is hashed and counted in words. A run is a stretch of such lines that follow one another in a document;
it is long enough if it has ``least_words`` words. A line is deleted if it is in a long enough run that stands, line by line the
same, at an earlier place too; places are ordered by document id, text hash and line. So the first copy stays.

1. Winnowing: the window of a line is the shortest long-enough stretch that starts there; the line of its least hash (the first of equal
   ones) is selected, once for all windows that it is the least of. Windows are cut by content alone, so all copies of a long enough run, which
   holds a whole window, select the same fingerprint there.
2. Positions are joined by fingerprint. One that is selected at a single place ends the matter: its windows can't repeat. Documents
   without any other end here.
3. Around the others the match is extended both ways: forward over the windows of the fingerprint, backward over the shortest long-enough
   stretch that ends at a line and begins with such a window. Every long enough common run is the union of such stretches. A stretch (at most
   ``least_words`` lines) is compared as a whole, by 128 bits over the 128 bits of each line, with the earliest place of its kind. Two
   places are never paired, so a line that stands in a third of all documents costs no more than others: each step is an aggregate with
   partial sums on the map side.

Defined results: a null text stays null, blank lines stay; rows equal in id and text are one document and get the same result;
extra columns pass through; a text of any length is read whole; of equal lines at one place of equal rows one counts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from prismframe.llm import common
from prismframe.llm.common import let, word_count

LEAST_WORDS = 50


def _key(id_col: str, text: str) -> list[Column]:
    return [F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t")]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, pos, h, g, words): the lines that are not blank, with two hashes and their numbers of words."""
    rows = docs.filter(F.col(f"`{text}`").isNotNull()).select(*_key(id_col, text), F.posexplode_outer(lines_of(F.col(f"`{text}`"))).alias("pos", "line"))
    return rows.select("d", "t", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), word_count(F.col("line")).alias("words")).filter("words > 0")


def _frames(least_words: int) -> tuple[WindowSpec, WindowSpec]:
    """Over words: the lines that start (end) less than least_words words from where this one starts (ends)."""
    ahead = Window.partitionBy("d", "t").orderBy("before").rangeBetween(0, least_words - 1)
    return ahead, Window.partitionBy("d", "t").orderBy("after").rangeBetween(-(least_words - 1), 0)


def winnowed(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(d, t, pos, h, g, before, after, mark, at): every line with its window's fingerprint and the line it is selected at; null without a window."""
    place = Window.partitionBy("d", "t").orderBy("pos")
    # rows equal in id and text put each line beside its twin
    once = lines.withColumn("twin", F.lag("pos").over(place)).filter("twin IS NULL OR twin <> pos")
    counted = once.withColumn("after", F.sum("words").over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("words"))
    ahead, _ = _frames(least_words)
    spans = counted.withColumns({"least": F.min(F.struct("h", "pos")).over(ahead), "upto": F.max("after").over(ahead)})
    least = F.when(F.col("upto") - F.col("before") >= least_words, F.col("least"))
    return spans.select("d", "t", "pos", "h", "g", "before", "after", least["h"].alias("mark"), least["pos"].alias("at"))


def stretches(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(d, t, start, end, run): the windows of marked lines (``seed``) and the stretches backward that begin with one, each with 128 bits of its lines."""
    ahead, back = _frames(least_words)
    spans = lines.select(
        "d", "t", "pos", "before", "after", "seed",
        F.collect_list(F.struct("h", "g")).over(ahead).alias("forward"), F.max("after").over(ahead).alias("forward_after"), F.max("pos").over(ahead).alias("forward_end"),
        F.collect_list(F.struct("h", "g")).over(back).alias("backward"), F.min("before").over(back).alias("backward_before"), F.min(F.struct("pos", "seed")).over(back).alias("first"),
    )
    forward = F.when(
        F.col("seed") & (F.col("forward_after") - F.col("before") >= least_words), F.struct(F.col("forward").alias("run"), F.col("pos").alias("start"), F.col("forward_end").alias("end"))
    )
    # a backward stretch that would be long enough without its last line's words is no line's window
    backward = F.when(
        F.col("first.seed") & (F.col("before") - F.col("backward_before") >= least_words), F.struct(F.col("backward").alias("run"), F.col("first.pos").alias("start"), F.col("pos").alias("end"))
    )
    found = spans.select("d", "t", F.explode(F.filter(F.array(forward, backward), lambda x: x.isNotNull())).alias("s"))
    run = F.struct(F.xxhash64(F.size("s.run"), F.col("s.run.h")).alias("h"), F.xxhash64(F.size("s.run"), F.col("s.run.g")).alias("g"))
    return found.select("d", "t", F.col("s.start").alias("start"), F.col("s.end").alias("end"), run.alias("run"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(d, t, start, end): stretches of lines of which an earlier place holds a copy."""
    # tables of their own, so that the joins read exchanges on both sides and a hot hash can be split
    lines = common.written(winnowed(line_table(docs, id_col, text), least_words))
    selected = lines.filter("mark IS NOT NULL").select("d", "t", "at", "mark").distinct()
    again = common.written(selected.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"))
    # each line with whether the fingerprint of its window stands elsewhere too, in the documents where one does
    # lines without a window are dealt by their own hash; a seed without a window starts no stretch
    keyed = lines.withColumn("mark", F.coalesce("mark", "h"))
    seeded = keyed.join(again.withColumn("known", F.lit(True)), "mark", "left").withColumn("seed", F.col("known").isNotNull())
    seeded = common.written(seeded.select("d", "t", "pos", "h", "g", "before", "after", "seed"))
    with_seeds = seeded.filter("seed").select("d", "t").distinct().select(F.col("d").alias("__d"), F.col("t").alias("__t"))
    marked = seeded.join(with_seeds, F.col("d").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t")), "left_semi")
    near = common.written(stretches(marked, least_words))
    first = near.groupBy("run").agg(F.min(F.struct("d", "t", "start")).alias("first"), F.count("*").alias("n"))
    first = common.written(first.filter("n > 1").drop("n"))
    return near.join(first, "run").filter(F.struct("d", "t", "start") > F.col("first")).select("d", "t", "start", "end")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns with the repeats taken out of ``text``, and ``n_lines``, ``n_removed``; input columns of these names give way."""
    runs = repeated_runs(docs, id_col, text, least_words)
    gone = runs.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "end")))).alias("__gone"))
    gone = gone.select(F.col("d").alias("__d"), F.col("t").alias("__t"), "__gone")
    d, t = _key(id_col, text)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep)).join(gone, d.eqNullSafe(F.col("__d")) & (t == F.col("__t")), "left")
    lines = lines_of(F.col(f"`{text}`"))

    def cleaned(x: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(x) - 1)
        blank = F.filter(every, lambda i: word_count(x[i]) == 0)
        return let(F.array_except("__gone", blank), lambda gone: F.struct(F.array_join(F.transform(F.array_except(every, gone), lambda i: x[i]), "\n").alias("text"), F.size(gone).alias("n")))

    # null without repeats, so that most texts aren't taken apart
    rows = rows.withColumn("__new", F.when(F.col("__gone").isNotNull(), let(lines, cleaned)))
    new = F.coalesce(F.col("__new.text"), F.col(f"`{text}`"))
    counted = {}
    counted["n_lines"] = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    counted["n_removed"] = F.coalesce(F.col("__new.n"), F.lit(0)).cast("long")
    return rows.select(*(new.alias(text) if c == text else F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in counted.items()))
