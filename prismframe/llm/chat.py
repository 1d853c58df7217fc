"""Chat formatting: schema fingerprints choose a declarative mapping to canonical turns; a template renders them reversibly.

Native: DataFrame functions only. Two kinds of input are covered.

* ``to_turns``: a DataFrame. The nested field paths of its schema are hashed; the fingerprint selects the mapping, which names the columns of the
  turns, whether a row is a conversation or a turn.
* ``json_turns``: one JSON record a row in any layout. The nested paths of each record that any mapping names are hashed in the row, and the
  fingerprint selects the mapping of that row.

``render`` writes turns with a template, ``read_back`` parses what it wrote. Defined results: a null text or role is empty; rows
that tie on the turn number are ordered by role and text, repeated rows are repeated turns; a null conversation id is a
conversation of its own; columns and fields that no mapping names are ignored, whatever they are called (an id, a source, a name beside a role);
where they leave no fingerprint that is known, the mapping with most paths of which all are there counts; an empty list of messages is a
conversation without turns; a record of no known layout has null turns and the fingerprint of its whole structure. Roles of lists are made
canonical, those of turn rows stay as they are written. A conversation of any length is one value, of at most 2 GB; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
ESC = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and every string that must not appear inside a text. A mark starts with a control string."""

    begin: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    control: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


CHATML = Template()


def escape(c: Column, template: Template = CHATML) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string."""
    c = F.replace(c, F.lit(ESC), F.lit(ESC * 2))
    for s in template.control:
        c = F.replace(c, F.lit(s), F.lit(s[0] + ESC + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


# ---------------------------------------------------------------- fingerprints and mappings


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves; ``[]`` marks an array's elements, ``{}`` a map's values."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _pair(*parts: tuple[str, str]) -> Callable[[], Column]:
    """Turns from scalar columns: (role, column)."""

    def build() -> Column:
        return F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).cast("string").alias("text")) for role, c in parts))

    return build


def _list(c: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(c), lambda x: F.struct(canonical_role(x[role]).alias("role"), x[text].cast("string").alias("text")))


def canonical_role(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("human", "user", "prompter"), F.lit("user")).when(low.isin("gpt", "assistant", "bot", "model"), F.lit("assistant")).otherwise(c.cast("string"))


def _instruction() -> Column:
    given = F.coalesce(F.col("input"), F.lit(""))
    user = F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.when(given == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), given)))
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("output").alias("text")))


@dataclass(frozen=True)
class Mapping:
    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column] | None  # None: a row is one turn, with its number, role and text in ``row``
    row: tuple[str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))


MAPPINGS = (
    Mapping("turn_rows", ("turn", "role", "text"), None, ("turn", "role", "text")),
    Mapping("message_rows", ("message_index", "role", "content"), None, ("message_index", "role", "content")),
    Mapping("messages", ("messages[].role", "messages[].content"), _list("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value")),
    Mapping("instruction_input", ("instruction", "input", "output"), _instruction),
    Mapping("instruction", ("instruction", "output"), _pair(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_completion", ("prompt", "completion"), _pair(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), _pair(("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("question", "answer"), _pair(("user", "question"), ("assistant", "answer"))),
)


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint is that of the schema's known paths; paths that no mapping names don't count.

    If a clashing extra column makes the known paths match no fingerprint, the mapping with most paths of which all are there.
    """
    known = {p for m in mappings for p in m.paths}
    there = [p for p in field_paths(schema) if p in known]
    chosen = {m.fingerprint: m for m in mappings}.get(fingerprint(there))
    if chosen is None:
        fit = [m for m in mappings if set(m.paths) <= set(there)]
        if not fit:
            raise ValueError(f"no mapping for a schema with the paths {sorted(field_paths(schema))}")
        chosen = max(fit, key=lambda m: len(m.paths))
    return chosen


def to_turns(df: DataFrame, id_col: str = "conv_id", block: int = 64, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, turns) of a DataFrame in any known layout.

    Turn rows are gathered in two steps, first by blocks of ``block`` turn numbers, so that a conversation with a large share of
    all rows is not gathered row by row in one task. A conversation's text is one value, so it must fit in one (2 GB).
    """
    mapping = select_mapping(df.schema, mappings)
    if mapping.turns is not None:
        return df.select(F.col(id_col), mapping.turns().cast(TURNS).alias("turns"))
    number, role, text = (F.col(f"`{c}`") for c in mapping.row)
    parts = (
        df.select(F.col(id_col), number.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        .groupBy(id_col, F.floor(F.col("turn") / block).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    )
    whole = parts.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("part", "rows"))).alias("parts"))
    rows = F.flatten(F.transform("parts", lambda p: p["rows"]))
    return whole.select(id_col, F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def _turn(role: str, body: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(canonical_role(x[role]).alias("role"), F.coalesce(x[body], F.lit("")).alias("text"))


def json_turns(df: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``fingerprint`` (long), ``layout`` and ``turns``, chosen row by row from the structure of a JSON record."""

    def structure(record: Column) -> Column:
        return F.regexp_replace(F.schema_of_variant(record), r"\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(_NTZ)?|DECIMAL\(\d+,\d+\))", "")

    record = F.try_parse_json(F.col(json_col))
    whole = [m for m in mappings if m.turns is not None]
    paths = sorted({p for m in whole for p in m.paths})

    def there(path: str) -> Column:
        """Whether a record has a path. The elements of an empty list have every path."""
        at, _, field = path.partition("[].")
        if not field:
            return F.try_variant_get(record, f"$.{at}", "variant").isNotNull()
        items = F.try_variant_get(record, f"$.{at}", "array<variant>")
        return F.coalesce((F.size(items) == 0) | F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))

    held = {p: there(p) for p in paths}
    known = F.array_compact(F.array(*(F.when(held[p], F.lit(p)) for p in paths)))
    print_ = F.when(F.size(known) > 0, F.xxhash64(F.array_join(known, "\n"))).otherwise(F.xxhash64(structure(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))

    def made(m: Mapping) -> Column:
        if m.paths[0].count("[]"):
            (c, role), (_, body) = (p.split("[].") for p in m.paths)
            items = F.try_variant_get(record, f"$.{c}", "array<variant>")
            return F.transform(items, lambda x: _turn(role, body)({k: F.try_variant_get(x, f"$.{k}", "string") for k in (role, body)}))
        user = text(m.paths[0])
        if len(m.paths) == 3:
            given = text(m.paths[1])
            user = F.concat(user, F.when(given == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), given)))
        return F.array(*(F.struct(F.lit(role).alias("role"), x.alias("text")) for role, x in (("user", user), ("assistant", text(m.paths[-1])))))

    # beyond the known fingerprints, the mapping with most paths of which all are there
    for exact in (False, True):
        for m in sorted(reversed(whole), key=lambda m: len(m.paths)):
            own = F.xxhash64(F.lit("\n".join(sorted(m.paths))))
            is_it = print_ == own if exact else F.forall(F.array(*(held[p] for p in m.paths)), lambda x: x)
            layout, turns = F.when(is_it, F.lit(m.name)).otherwise(layout), F.when(is_it, made(m)).otherwise(turns)
    return df.withColumns({"fingerprint": print_, "layout": layout, "turns": turns})


# ---------------------------------------------------------------- rendering and reading back


def render(df: DataFrame, turns: str = "turns", template: Template = CHATML, loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: for each turn, where in the turn's piece of ``formatted`` the loss mask lies.

    A piece is a turn with its marks, ending with the end mark. A span has ``start`` and ``len`` in code points, null without loss.
    """

    def part(t: Column, name: str) -> Column:
        return escape(F.coalesce(t[name], F.lit("")), template)

    pieces = F.transform(turns, lambda t: F.concat(F.lit(template.begin), part(t, "role"), F.lit(template.sep), part(t, "text"), F.lit(template.end)))
    ahead = len(template.begin) + len(template.sep)
    span = F.transform(
        turns,
        lambda t: F.when(t["role"] == loss_role, F.struct((F.length(part(t, "role")) + ahead).alias("start"), F.length(part(t, "text")).alias("len"))),
    )
    return df.withColumns({"formatted": F.array_join(pieces, ""), "loss_spans": span})


def read_back(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """Adds ``parsed`` (turns) and ``loss_text``, both made from ``formatted`` and ``loss_spans`` alone."""
    split = F.split(F.col("formatted"), re.escape(template.end))
    pieces = F.slice(split, 1, F.size(split) - 1)
    body = F.transform(pieces, lambda p: F.split(F.substring(p, len(template.begin) + 1, 2**31 - 1), re.escape(template.sep)))
    parsed = F.transform(body, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))
    masked = F.zip_with(pieces, F.col("loss_spans"), lambda p, s: F.when(s.isNotNull(), unescape(p.substr(s["start"] + 1, s["len"]))))
    return df.withColumns({"parsed": parsed, "loss_text": F.array_join(F.filter(masked, lambda x: x.isNotNull()), "")})


def digest(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The contract's columns from what ``read_back`` has parsed."""
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
