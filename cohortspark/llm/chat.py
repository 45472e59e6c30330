"""Chat formatting: heterogeneous layouts to canonical turns, to one marked string, and back. Native.

A layout is known by its schema fingerprint: the SHA-1 of the sorted nested field paths that a row fills
(arrays are written ``name[]``). ``MAPPINGS`` declares, per layout, which paths make the turns; the
fingerprints of a mapping (its required paths with any of its optional ones) are compiled into one
conditional expression, so rows of several layouts may share a table.

The template writes a turn as ``### role: text</turn>`` and a newline. Control strings inside roles and texts
are escaped reversibly: no marker ever appears inside an escaped text, so splitting at the end marker is exact.

Defined results: null texts and roles are empty; a null turn number sorts first, ties by role, then text, and
repeated rows are repeated turns; rows with a null key form one conversation; rows whose fingerprint no mapping
knows are returned by ``unmapped`` and make no turns; an empty table gives no rows; other columns are ignored.
A conversation is one string, so its turns meet in one row by definition; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<turn:bigint,role:string,text:string>"
START, MIDDLE, END = "### ", ": ", "</turn>\n"
#: control string -> escape; the backslash goes first when escaping and last when unescaping
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
#: role names of other layouts
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: ``required`` and ``optional`` field paths and how they become turns.

    ``kind``: ``row`` (a row is a turn), ``list`` (an array of turns), ``fields`` (each field is a turn).
    ``turns``: for ``row`` and ``list`` the names of (turn number or None, role, text); for ``fields`` pairs of
    (role, path), where several paths of one role in a row are joined by a blank line.
    """

    name: str
    required: tuple[str, ...]
    turns: tuple
    kind: str
    optional: tuple[str, ...] = ()
    roles: bool = True


MAPPINGS = (
    Mapping("turn_rows", ("turn",), ("turn", "role", "text"), "row", ("role", "text"), roles=False),
    Mapping("role_rows", ("role",), ("turn", "role", "text"), "row", ("text",), roles=False),
    Mapping("messages", ("messages[].role", "messages[].content"), ("messages", "role", "content"), "list"),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value"), "list"),
    Mapping("instruction", ("instruction", "output"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), "fields", ("input", "system")),
    Mapping("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion")), "fields"),
    Mapping("prompt_response", ("prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response")), "fields", ("system",)),
    Mapping("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer")), "fields"),
    Mapping("message_pair", ("message.prompt", "message.reply"), (("user", "message.prompt"), ("assistant", "message.reply")), "fields"),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The paths of all leaves below a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _column(path: str) -> Column:
    parts = path.split(".")
    column = F.col(f"`{parts[0]}`")
    for part in parts[1:]:
        column = column[part]
    return column


def _known(mappings: tuple[Mapping, ...]) -> list[str]:
    return sorted({p for m in mappings for p in (*m.required, *m.optional)})


def _digest(paths) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """SHA-1 of the sorted known paths that a row fills; a path below an array counts if the array is there."""
    there = set(field_paths(df.schema))
    filled = [
        F.when(_column(p.split("[]")[0]).isNotNull(), F.lit(p)) for p in _known(mappings) if p in there
    ]
    return F.sha1(F.concat_ws("\n", *filled)) if filled else F.lit(_digest(()))


def _fingerprints(mapping: Mapping) -> list[str]:
    n = len(mapping.optional)
    return [
        _digest((*mapping.required, *some)) for k in range(n + 1) for some in combinations(mapping.optional, k)
    ]


def _role(role: Column, renamed: bool) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    if not renamed:
        return role
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(role)), role)


def _turn(number: Column, role: Column, text: Column) -> Column:
    return F.struct(
        number.cast("bigint").alias("turn"), role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")
    )


def _turns(mapping: Mapping, there: set[str]) -> Column:
    if mapping.kind == "row":
        number, role, text = mapping.turns
        number, role, body = (_column(p) if p in there else F.lit(None) for p in (number, role, text))
        return F.array(_turn(number, _role(role, mapping.roles), body))
    if mapping.kind == "list":
        items, role, text = mapping.turns
        return F.transform(
            _column(items), lambda x, i: _turn(i, _role(x[role], mapping.roles), x[text])
        )
    made = []
    for k, role in enumerate(dict.fromkeys(r for r, _ in mapping.turns)):
        parts = [_column(p) for r, p in mapping.turns if r == role and p in there]
        if parts:
            given = F.lit(False)
            for part in parts:
                given |= part.isNotNull()
            made.append(F.when(given, _turn(F.lit(k), F.lit(role), F.concat_ws("\n\n", *parts))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def to_turns(df: DataFrame, key: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, layout, turns): each row's canonical turns by the mapping its fingerprint selects."""
    there = set(field_paths(df.schema))
    print_ = F.col("__print")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for mapping in mappings:
        if set(mapping.required) <= there:
            hit = print_.isin(_fingerprints(mapping))
            layout = F.when(hit, F.lit(mapping.name)).otherwise(layout)
            turns = F.when(hit, _turns(mapping, there).cast(f"array<{TURN}>")).otherwise(turns)
    return df.withColumn("__print", fingerprint(df, mappings)).select(
        F.col(f"`{key}`").alias(key), layout.alias("layout"), turns.alias("turns")
    )


def unmapped(df: DataFrame, key: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Keys and fingerprints of the rows that no mapping knows."""
    return (
        df.withColumn("__print", fingerprint(df, mappings))
        .where(~F.col("__print").isin([p for m in mappings for p in _fingerprints(m)]))
        .select(key, F.col("__print").alias("fingerprint"))
    )


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_conversations(
    df: DataFrame, key: str, mappings: tuple[Mapping, ...] = MAPPINGS, trained: str = "assistant"
) -> DataFrame:
    """(key, formatted, loss_spans): one string per conversation; a span (start, length) is a trained text."""
    turns = to_turns(df, key, mappings).where(F.col("turns").isNotNull())
    # a turn number orders a row against the other rows of its conversation, and turns inside a row
    whole = turns.groupBy(key).agg(
        F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns")
    )
    heads = F.transform("turns", lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE)))
    whole = whole.withColumn("__heads", heads).withColumn("__texts", F.transform("turns", lambda t: escape(t["text"])))
    whole = whole.withColumn(
        "__parts", F.transform(F.arrays_zip("__heads", "__texts"), lambda x: F.concat(x["__heads"], x["__texts"], F.lit(END)))
    )
    starts = F.aggregate(
        F.arrays_zip(F.col("__heads").alias("h"), F.col("__texts").alias("t"), F.col("turns").alias("u")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["h"]) + F.length(x["t"]) + len(END)).alias("at"),
            F.when(
                x["u"]["role"] == trained,
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["h"])).alias("start"), F.length(x["t"]).cast("bigint").alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return whole.select(key, F.array_join("__parts", "").alias("formatted"), starts.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns, as (role, text), that a formatted string holds."""
    pieces = F.filter(F.split(formatted, F.lit(END)), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(
                F.replace(F.substring_index(F.substr(x, F.lit(len(START) + 1)), MIDDLE, 1), F.lit("\\c"), F.lit(":"))
            ).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text"),
        ),
    )


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
