"""Chat formatting by schema fingerprint, in built-in functions only.

A record may hold its conversation in one of several layouts (message lists,
instruction columns, prompt and answer columns).  Its fingerprint is the hash
of the nested field paths that are present in it (``messages[].role`` and so
on); the fingerprint selects a declarative mapping that yields canonical turns
(role, text).  The turns are written with a template, control strings inside
texts escaped reversibly, with the byte spans that carry loss beside it.

Template: ``<turn ROLE>\\nTEXT</turn>\\n`` for each turn.  Escapes, undone in the
reverse order: a backslash becomes ``\\b``; the ``<`` of ``<turn`` or ``</turn``
becomes ``\\l``; in roles ``>`` becomes ``\\g``.

Cases: a null text is an empty one, a null role an empty role; a record with no
known layout keeps its row with null turns; rows of one conversation with equal
turn numbers go by role, then text; repeated rows are repeated turns; an empty
table gives an empty result; other columns are passed on.  A conversation is
one value, as its formatted text is.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

END = "</turn>\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping from field paths to turns.

    ``rows``: (list column, role field, text field) of a list of messages; or
    ``turns``: (role, paths) in order, the texts of several paths joined by a
    blank line and a turn without any of them left out.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    rows: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].role",), ("messages[].content",), rows=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from",), ("conversations[].value",),
           rows=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "response"), ("system",),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", ("prompt", "completion"), ("system",),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("question", "answer"), ("system",),
           turns=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)
#: other names of the three roles
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _roots(layouts: tuple[Layout, ...]) -> set[str]:
    return {p.replace("[]", "").split(".")[0] for x in layouts for p in (*x.required, *x.optional)}


def _any_has(col: Column, name: str) -> Column:
    return F.coalesce(F.exists(col, lambda x: x.getField(name).isNotNull()), F.lit(False))


def field_paths(kind: DataType, col: Column, path: str) -> list[tuple[str, Column]]:
    """(path, whether it is present) of every leaf below a column."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in field_paths(f.dataType, col.getField(f.name), f"{path}.{f.name}")]
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StructType):
            return [(f"{path}[].{n}", _any_has(col, n)) for n in kind.elementType.names]
        return [(f"{path}[]", F.size(col) > 0)]
    return [(path, col.isNotNull())]


def _hash(paths: Column) -> Column:
    return F.xxhash64(paths)


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the sorted field paths present in a record, among the columns
    that a layout names; other columns have no say."""
    roots = _roots(layouts)
    leaves = sorted((x for f in df.schema.fields if f.name in roots
                     for x in field_paths(f.dataType, F.col(f"`{f.name}`"), f.name)), key=lambda x: x[0])
    if not leaves:
        return _hash(F.lit(""))
    return _hash(F.concat_ws("\n", *[F.when(there, F.lit(path)) for path, there in leaves]))


def fingerprints_of(layout: Layout) -> list[Column]:
    """The fingerprints a layout can have: its required paths with any choice
    of the optional ones."""
    choices = [c for n in range(len(layout.optional) + 1) for c in combinations(layout.optional, n)]
    return [_hash(F.lit("\n".join(sorted({*layout.required, *c})))) for c in choices]


def _role(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(col == other, F.lit(name)).otherwise(out)
    return out


def _turns(layout: Layout, df: DataFrame) -> Column:
    if layout.rows:
        rows, role, text = layout.rows
        kind = df.schema[rows].dataType.elementType
        content = (lambda m: F.coalesce(m.getField(text), F.lit(""))) if text in kind.names else (lambda m: F.lit(""))
        return F.transform(F.col(f"`{rows}`"), lambda m: F.struct(
            _role(m.getField(role)).alias("role"), content(m).alias("text")))
    out = []
    for role, paths in layout.turns:
        there = [F.col(f"`{p}`").cast("string") for p in paths if p in df.columns]
        if there:
            out.append(F.struct(F.lit(role).alias("role"), F.when(
                F.coalesce(*there).isNotNull(), F.concat_ws("\n\n", *there)).alias("text")))
    return F.filter(F.array(*out), lambda x: x["text"].isNotNull())


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with layout (its name, null if unknown) and turns
    (array of role and text)."""
    df = df.drop("layout", "turns")
    print_ = fingerprint(df, layouts)
    paths = {p for f in df.schema.fields for p, _ in field_paths(f.dataType, F.col(f"`{f.name}`"), f.name)}
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        if set(layout.required) <= paths:
            here = print_.isin(*fingerprints_of(layout))
            name = F.when(here, F.lit(layout.name)).otherwise(name)
            turns = F.when(here, _turns(layout, df)).otherwise(turns)
    return df.withColumns({"layout": name, "turns": turns})


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), "<(?=/?turn)", r"\\l")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    for code, char in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def formatted(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """``df`` with formatted (string, null without turns) and loss_spans:
    (start, length) in bytes of the formatted text, one per assistant turn."""
    parts = F.transform(F.col(turns_col), lambda t: F.struct(
        F.concat(F.lit("<turn "), escape_role(F.coalesce(t["role"], F.lit(""))), F.lit(">\n")).alias("head"),
        escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (t["role"] == LOSS_ROLE).alias("loss")))
    none = F.lit(None).cast("array<struct<start:bigint,length:bigint>>")
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    size = lambda c: F.octet_length(c).cast("long")

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + size(p["head"])
        span = F.struct(begin.alias("start"), size(p["body"]).alias("length"))
        return F.struct((begin + size(p["body"]) + len(END)).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def built(p: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
            F.aggregate(p, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), add,
                        lambda acc: acc["spans"]).alias("spans"))

    df = df.drop("formatted", "loss_spans")
    made = F.get(F.transform(F.array(parts), built), F.lit(0))
    there = F.col(turns_col).isNotNull()
    df = df.withColumn("_formatted", F.when(there, made))
    return df.withColumns({"formatted": F.col("_formatted")["formatted"],
                           "loss_spans": F.coalesce(F.col("_formatted")["spans"], none)}).drop("_formatted")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, END, -1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">\n", 1)
        return F.struct(unescape(F.substr(head, F.lit(7))).alias("role"),
                        unescape(F.substr(p, F.length(head) + 3)).alias("text"))

    return F.transform(F.filter(pieces, lambda p, i: p != ""), turn)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    whole = text.cast("binary")
    return F.get(F.transform(F.array(whole), lambda b: F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(b, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), "")), F.lit(0))


def message_lists(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One record per conversation, in the messages layout, from one row per turn."""
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("content"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"], m["content"])).alias("messages"))
