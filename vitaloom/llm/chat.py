"""Chat formatting: layouts told apart by hashed field paths, one canonical turn table, a reversible template.

Only DataFrame and SQL functions run. A layout is a declarative :class:`Mapping` from field paths to the canonical
columns (conv_id, turn, role, text). The paths of a table's schema are hashed; the mapping whose hashed
paths all occur is taken (the most specific one first), so extra columns never matter. For JSON text the same is
done row by row: a fold over the row's shape gives its nested paths, which are hashed, so that ``meta.prompt`` is not ``prompt``; rows of all
layouts are read in one scan.

Template: an assistant turn is ``<s>role NEWLINE text</s>``, any other ``[INST]role NEWLINE text[/INST]``. Control
strings inside a text lose their first character to an escape (backslash and digit), backslashes are escaped
too, so block ends in the output are real ends and reading back gives every text unchanged.

Defined results: null texts and roles count as empty; a row without conversation id is left out; turns come in
order of turn, then role, then text, so ties and repeated rows have a fixed order and all stay; an unknown layout raises
for a table and gives no turns for a JSON row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom.llm.common import sums_before

#: Strings that mean something to a reader of the template.
CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<unk>", "<pad>")
#: Escapes: the backslash itself, then what a control string may begin with; the line break is escaped in roles.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
LINE = ("\n", "\\3")


class Mapping(NamedTuple):
    """paths: what must be there. turns: SQL for array<struct<turn,role,text>>, or None for one turn a row."""

    name: str
    paths: tuple[str, ...]
    conv_id: str
    turns: str | None = None
    row: tuple[str, str, str] | None = None


#: Declarative mappings, most specific first.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), "conv_id", row=("turn", "role", "text")),
    Mapping("messages", ("conv_id", "messages[].role", "messages[].content"), "conv_id", "transform(messages, (m, i) -> struct(cast(i as bigint) as turn, cast(m.role as string) as role, cast(m.content as string) as text))"),
    Mapping("from_value", ("conv_id", "conversations[].from", "conversations[].value"), "conv_id", "transform(conversations, (m, i) -> struct(cast(i as bigint) as turn, case cast(m.from as string) when 'human' then 'user' when 'gpt' then 'assistant' else cast(m.from as string) end as role, cast(m.value as string) as text))"),
    Mapping("instruction_input", ("conv_id", "instruction", "input", "output"), "conv_id", "array(struct(0L as turn, 'user' as role, concat_ws('\\n\\n', nullif(cast(instruction as string), ''), nullif(cast(input as string), '')) as text), struct(1L as turn, 'assistant' as role, cast(output as string) as text))"),
    Mapping("instruction", ("conv_id", "instruction", "output"), "conv_id", "array(struct(0L as turn, 'user' as role, cast(instruction as string) as text), struct(1L as turn, 'assistant' as role, cast(output as string) as text))"),
    Mapping("prompt_chosen", ("conv_id", "prompt", "chosen"), "conv_id", "array(struct(0L as turn, 'user' as role, cast(prompt as string) as text), struct(1L as turn, 'assistant' as role, cast(chosen as string) as text))"),
    Mapping("prompt_response", ("conv_id", "prompt", "response"), "conv_id", "array(struct(0L as turn, 'user' as role, cast(prompt as string) as text), struct(1L as turn, 'assistant' as role, cast(response as string) as text))"),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema: a.b for fields (in back-ticks where a name is no identifier), [] for elements, {} for map values."""
    if isinstance(kind, T.StructType):
        named = lambda n: n if re.fullmatch(r"(?!\d+$)[A-Za-z0-9_]+", n) else "`" + n.replace("`", "``") + "`"
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{named(f.name)}" if prefix else named(f.name))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, prefix + "{}")
    return [prefix]


def path_hash(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def fingerprint(schema: T.StructType) -> str:
    """One hash for all nested field paths of a schema, whatever their order."""
    return hashlib.sha256("\n".join(sorted(map(path_hash, field_paths(schema)))).encode()).hexdigest()


_TABLE = [({path_hash(p) for p in m.paths}, m) for m in MAPPINGS]


def mapping_of(schema: T.StructType) -> Mapping:
    there = set(map(path_hash, field_paths(schema)))
    for needed, m in _TABLE:
        if needed <= there:
            return m
    raise ValueError(f"no mapping for a layout with fields {sorted(field_paths(schema))}")


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table in any mapped layout."""
    m = mapping_of(df.schema)
    if m.row:
        turn, role, text = m.row
        out = df.select(F.col(m.conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    else:
        out = df.select(F.col(m.conv_id).cast("long").alias("conv_id"), F.inline(F.expr(m.turns)))
    return out.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


#: Types that JSON rows are read with: the fields of all mappings side by side.
_JSON_SCHEMA = (
    "conv_id long, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>,"
    " instruction string, input string, output string, prompt string, chosen string, response string"
)
#: Parts of a shape: names, the begin and end of objects and arrays, and plain types.
_SHAPE = r"`(?:[^`]|``)*`: |[A-Za-z0-9_]+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9, ]*\))?"


def json_paths(json: Column) -> Column:
    """Leaf paths of a JSON text, written as :func:`field_paths` writes them: a fold over the parts of its shape with a stack of what is open."""
    parts = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(json)), F.lit(_SHAPE), F.lit(0))
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(a: Column, x: Column) -> Column:
        inside = F.element_at(a["open"], -1)
        name = F.left(x, F.length(x) - 2)
        named = F.when(inside == "", name).otherwise(F.concat(inside, F.lit("."), name))
        to = lambda open_, at, paths: F.struct(open_.alias("open"), at.alias("at"), paths.alias("paths"))
        return (
            F.when(F.endswith(x, F.lit(": ")), to(a["open"], named, a["paths"]))
            .when(x == "OBJECT<", to(F.concat(a["open"], F.array(a["at"])), a["at"], a["paths"]))
            .when(x == "ARRAY<", to(F.concat(a["open"], F.array(inside)), F.concat(a["at"], F.lit("[]")), a["paths"]))
            .when(x == ">", to(F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1), inside, a["paths"]))
            .otherwise(to(a["open"], a["at"], F.concat(a["paths"], F.array(a["at"]))))
        )

    return F.aggregate(parts, start, step)["paths"]


def _hashed(paths: Column) -> Column:
    return F.transform(paths, lambda p: F.left(F.sha2(p, 256), F.lit(16)))


def json_fingerprint(json: Column) -> Column:
    """One hash for all nested field paths of a JSON text, that of a table of the same fields; null for no valid JSON."""
    return F.sha2(F.array_join(F.array_sort(_hashed(json_paths(json))), "\n"), 256)


def canonical_turns_of_json(df: DataFrame, json_col: str) -> DataFrame:
    """conv_id, turn, role, text of JSON texts whose layout differs from row to row, in one scan.

    The first mapping whose hashed paths all occur among the row's reads it; a row without one, or that is no JSON, gives no turns.
    """
    rows = df.select(F.col(json_col).alias("_json")).withColumn("_there", _hashed(json_paths(F.col("_json")))).withColumn("_row", F.from_json("_json", _JSON_SCHEMA))
    rows = rows.select("_there", "_row.*")
    turns = None
    for needed, m in _TABLE:
        if m.turns is None:
            continue
        fits = F.size(F.array_except(F.array(*map(F.lit, sorted(needed))), F.col("_there"))) == 0
        turns = F.when(fits, F.expr(m.turns)) if turns is None else turns.when(fits, F.expr(m.turns))
    out = rows.select("conv_id", F.inline(turns)).where("conv_id IS NOT NULL")
    return out.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def escape(c: Column, line: bool = False) -> Column:
    back, *opens = ESCAPES
    c = F.replace(c, F.lit(back[0]), F.lit(back[1]))
    code = dict(opens)
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(code[s[0]] + s[1:]))
    return F.replace(c, F.lit(LINE[0]), F.lit(LINE[1])) if line else c


def unescape(c: Column) -> Column:
    for plain, coded in (LINE, *ESCAPES[1:], ESCAPES[0]):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: array<struct<start, end>> in code points of the escaped assistant texts.

    Blocks are built a row; the group only joins them. A conversation is one output string, so it must meet in one task.
    """
    role, text = escape(F.col("role"), line=True), escape(F.col("text"))
    assistant = F.col("role") == "assistant"
    open_, shut = F.when(assistant, "<s>").otherwise("[INST]"), F.when(assistant, "</s>").otherwise("[/INST]")
    head = F.concat(open_, role, F.lit("\n"))
    rows = turns.withColumn("block", F.concat(head, text, shut)).withColumn("at", F.length(head)).withColumn("size", F.when(assistant, F.length(text)).otherwise(-1))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "block", "at", "size"))).alias("b"))
    rows = rows.withColumn("sizes", F.transform("b", lambda x: F.length(x["block"])))
    rows = rows.withColumn("before", sums_before("sizes"))
    spans = F.filter(F.transform("b", lambda x, i: F.struct((F.get("before", i) + x["at"]).alias("start"), (F.get("before", i) + x["at"] + x["size"]).alias("end"), (x["size"] >= 0).alias("own"))), lambda x: x["own"])
    return rows.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("formatted"), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``: array<struct<role, text>> and ``loss_text``, both taken from the output alone."""
    blocks = F.array_remove(F.split("formatted", r"(?<=\[/INST\]|</s>)"), "")
    inner = F.transform(blocks, lambda b: F.when(F.startswith(b, F.lit("<s>")), F.substring(b, F.lit(4), F.length(b) - 7)).otherwise(F.substring(b, F.lit(7), F.length(b) - 13)))
    turns = F.transform(inner, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
