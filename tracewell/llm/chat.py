"""Chat formatting: heterogeneous layouts to canonical turns to one marked-up string.

Method.  A layout is known by a fingerprint, the hash of its sorted nested field paths.  What a
table's schema, or one JSON text, has of a mapping's paths is hashed and compared with the
mapping's own fingerprint, so further fields change nothing; of the mappings that fit, the one
with the most paths is taken.  A mapping is declarative, a handful of field names, and turns
prompt, instruction and message layouts into canonical turns ``array<struct<role, text>>``.

The template writes a turn as ``<s>role[INST]text</s>``.  Control strings that occur inside a
role or a text are escaped reversibly: ``~`` becomes ``~0`` and each control string ``~`` and
its number, so an unescaped control string is always the template's.  The loss mask lists the
spans of assistant text as (start, length) in characters of the formatted string.

Everything is DataFrame expressions.  The only shuffle brings the turns of a conversation
together; a conversation is one output string, so it is as large as a record has to be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings, in the order of their escape numbers.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, BODY = "<s>", "</s>", "[INST]"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    pairs: (role, field) in order, for prompt and instruction layouts; a null field gives no
    turn.  messages: a field holding an array, with the element fields of role and text.
    rows: the table has a row for each turn, with fields for order, role and text.
    roles: names of roles that the layout has for user and assistant.
    """

    paths: Sequence[str]
    pairs: Sequence[tuple[str, str]] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    roles: Sequence[tuple[str, str]] = ()


def fingerprint(paths: Sequence[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of a schema, inner ones and leaves, elements of an array as ``[]``."""
    here = [prefix] if prefix else []
    if isinstance(schema, T.StructType):
        return here + [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return here + field_paths(schema.elementType, prefix + "[]")
    return here


#: Layouts by name.  Fixed values: the field names that public chat data sets use.
MAPPINGS = {
    "turn_rows": Mapping(["turn", "role", "text"], rows=("turn", "role", "text")),
    "messages": Mapping(["messages[].role", "messages[].content"], messages=("messages", "role", "content")),
    "conversations": Mapping(["conversations[].from", "conversations[].value"], messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    "prompt_response": Mapping(["prompt", "response"], pairs=(("user", "prompt"), ("assistant", "response"))),
    "prompt_completion": Mapping(["prompt", "completion"], pairs=(("user", "prompt"), ("assistant", "completion"))),
    "question_answer": Mapping(["question", "answer"], pairs=(("user", "question"), ("assistant", "answer"))),
    "system_prompt_response": Mapping(["system", "prompt", "response"], pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "instruction": Mapping(["instruction", "input", "output"], pairs=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    "instruction_output": Mapping(["instruction", "output"], pairs=(("user", "instruction"), ("assistant", "output"))),
}
#: By fingerprint, those with most paths first.
REGISTRY = {fingerprint(m.paths): name for name, m in sorted(MAPPINGS.items(), key=lambda x: -len(x[1].paths))}


def _turn(m: Mapping, role: Column, text: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for said, name in m.roles:
        role = F.when(role == said, name).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _by_row(m: Mapping, field) -> Column:
    """Turns of a row under a mapping; ``field(name)`` gives the column of a field."""
    if m.messages:
        name, role, text = m.messages
        return F.coalesce(F.transform(field(name), lambda x: _turn(m, x[role], x[text])), F.array().cast(TURNS))
    found = F.array(*[F.when(field(f).isNotNull(), _turn(m, F.lit(r), field(f))) for r, f in m.pairs])
    return F.filter(found, lambda x: x.isNotNull()).cast(TURNS)


def turns_of_table(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, pos, role, text) of a table whose own schema is a known layout.

    Columns beyond those of the layout are ignored: the mapping with the most paths among
    those the schema holds is taken.  A table with a row for each turn is ordered by turn,
    then role and text; null order comes first, null roles and texts count as empty.
    """
    paths = set(field_paths(T.StructType([f for f in df.schema if f.name != key])))
    fits = [name for code, name in REGISTRY.items() if fingerprint(sorted(paths & set(MAPPINGS[name].paths))) == code]
    if not fits:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    m = MAPPINGS[fits[0]]
    if m.rows:
        order, role, text = (F.col(c) for c in m.rows)
        at = F.struct(order.alias("o"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
        return df.select(F.col(key).alias("key"), at.alias("pos"), _turn(m, role, text).alias("turn")).select("key", "pos", "turn.role", "turn.text")
    return exploded(df.select(F.col(key).alias("key"), _by_row(m, F.col).alias("turns")))


def json_paths(text: Column, depth: int = 3) -> Column:
    """The nested paths of a JSON object in a text column, ``depth`` levels of them, by expressions.

    Inner paths and leaves, as in field_paths; the fields of an array's elements are those of
    its first one.  Null for a text that is no object.
    """

    def inside(value: Column, path: Column, left: int) -> Column:
        if not left:
            return F.array(path)
        fields = F.coalesce(below(value, path, left - 1), F.array().cast("array<string>"))
        first = F.get_json_object(value, "$[0]")
        elements = F.when(first.isNotNull(), inside(first, F.concat(path, F.lit("[]")), left - 1)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(path), fields, elements)

    def below(value: Column, path: Column | None, left: int) -> Column:
        def field(name: Column) -> Column:
            found = F.call_function("get_json_object", value, F.concat(F.lit("$['"), name, F.lit("']")))
            return inside(found, name if path is None else F.concat(path, F.lit("."), name), left)

        return F.flatten(F.transform(F.json_object_keys(value), field))

    return below(text, None, depth)


def turns_of_json(df: DataFrame, json_col: str, key: str = "conv_id") -> DataFrame:
    """Rows (key, layout, turns) of JSON texts whose layout may differ from row to row.

    The fingerprint of each row looks its mapping up; fields beyond it are ignored.  Null or
    broken texts and unknown layouts give null turns and a null layout, so that nothing is lost
    unseen.
    """
    text = F.col(json_col)
    seen = df.select(F.col(key).alias("key"), text.alias("_json"), json_paths(text).alias("_paths"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for code, name in reversed([(c, n) for c, n in REGISTRY.items() if not MAPPINGS[n].rows]):
        m = MAPPINGS[name]
        if m.messages:
            kind = f"array<struct<{m.messages[1]}:string,{m.messages[2]}:string>>"
            get = lambda f, kind=kind: F.from_json(F.get_json_object("_json", f"$.{f}"), kind)
        else:
            get = lambda f: F.get_json_object("_json", f"$.{f}")
        held = F.array_sort(F.array_intersect("_paths", F.array(*[F.lit(p) for p in m.paths])))
        same = F.substring(F.sha2(F.array_join(held, "\n"), 256), 1, 16) == code
        layout = F.when(same, F.lit(name)).otherwise(layout)
        turns = F.when(same, _by_row(m, get)).otherwise(turns)
    return seen.select("key", layout.alias("layout"), turns.alias("turns"))


def exploded(rows: DataFrame) -> DataFrame:
    """(key, turns) as rows (key, pos, role, text).

    Null turns, those of an unknown layout, give one row with a null role, so that the
    conversation stays; a known layout without turns gives none.
    """
    turns = rows.where("turns is null or size(turns) > 0").select("key", F.posexplode_outer("turns").alias("o", "turn"))
    at = F.struct(F.col("o").cast("long").alias("o"), F.col("turn.role").alias("r"), F.col("turn.text").alias("t"))
    return turns.select("key", at.alias("pos"), "turn.role", "turn.text")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"~{k}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(f"~{k}"), F.lit(control))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss) from (key, pos, role, text).

    loss: array of (start, length) of the escaped assistant texts, in characters from 0.
    Turns with a null key form one conversation.  Turns alike in order, role and text each
    stay.  A row with a null role is no turn; a conversation of such rows alone is empty.  No
    rows give no rows.
    """
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(BODY))
    body = escape(F.col("text"))
    parts = turns.select("key", "pos", "role", head.alias("head"), body.alias("body"))
    part = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length(part)).over(before), F.lit(0))
    placed = parts.select("key", at.alias("at"), part.alias("part"), "role", F.struct((at + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")).alias("span"))
    whole = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("at", "part", "role", "span")))).alias("p"))
    return whole.select(
        F.col("key").alias("conv_id"),
        F.array_join(F.transform("p", lambda x: x["part"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["role"] == "assistant"), lambda x: x["span"]).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped: array<struct<role, text>>."""
    pieces = F.split(formatted, r"</s>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda p: F.substring_index(p, BODY, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(role(p), F.lit(len(BEGIN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + len(BODY) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
