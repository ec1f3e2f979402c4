"""Chat formatting: layouts are recognised by a hash of their field paths, in SQL functions only.

Every layout has a set of nested field paths and a declarative mapping to
canonical turns (conv_id, turn, role, text). A table's fingerprint is the SHA-256
of its known paths, sorted; unknown columns don't count. The fingerprint selects
the mapping; if several layouts' columns meet in one table, the layout with the
most paths that are all present is taken (of equals, the first listed). Records
in JSON text are treated alike, row by row, by the paths of each record.

A turn is written  <s>[INST]role[/INST]text</s>.  In roles and texts a backslash
is doubled and a backslash is put after the first character of each mark, so no
mark can appear in them and reading back is exact. A conversation is an array of
segments (text, loss); loss is set on assistants' texts alone, and the formatted
text is the segments in order.

A conversation's turns meet in one task, as its formatted text is one value;
nothing else is gathered. Order is by turn (null first), then role, then text.

Defined results: null roles and texts count as empty; every row without conv_id is
a conversation of its own (with a null id), as nothing tells it from the others;
repeated rows are repeated turns; other columns are not read; an empty table gives
no rows; a table of no known layout raises ValueError, a JSON record of none (or no
JSON) is dropped into the rejects that `canonical_json` returns beside the turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table, written

MARKS = ["<s>", "</s>", "[INST]", "[/INST]"]
_HEAD, _MID, _END = "<s>[INST]", "[/INST]", "</s>"
_MARK = r"([<\[])(/?(?:s>|INST\]))"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    paths: tuple[str, ...]  # `a.b` for fields, `a[]` for elements
    turns: str  # SQL: an array of struct<role, text>; for rows, one turn
    rows: bool = False


_ALIAS = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"
_PAIR = "array(named_struct('role', 'user', 'text', string({0})), named_struct('role', 'assistant', 'text', string({1})))"
LAYOUTS = {
    "rows": Layout(("conv_id", "role", "text", "turn"), "named_struct('role', string(role), 'text', string(text))", True),
    "messages": Layout(("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', string(m.role), 'text', string(m.content)))"),
    "from_value": Layout(("conversations[].from", "conversations[].value"), f"transform(conversations, m -> named_struct('role', {_ALIAS.format('string(m.from)')}, 'text', string(m.value)))"),
    "instruction": Layout(("input", "instruction", "output"), _PAIR.format("concat(instruction, IF(coalesce(input, '') = '', '', concat('\\n', input)))", "output")),
    "instruction_only": Layout(("instruction", "output"), _PAIR.format("instruction", "output")),
    "prompt_response": Layout(("prompt", "response"), _PAIR.format("prompt", "response")),
    "prompt_completion": Layout(("completion", "prompt"), _PAIR.format("prompt", "completion")),
    "question": Layout(("answer", "question"), _PAIR.format("question", "answer")),
}
#: The types in which JSON records are read.
_JSON = {
    "messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>",
    **dict.fromkeys(["input", "instruction", "output", "prompt", "response", "completion", "question", "answer"], "string"),
}


def paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of all leaves of a schema."""
    if isinstance(kind, T.StructType):
        return set().union(*(paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(found: set[str] | tuple[str, ...]) -> str:
    known = {p for layout in LAYOUTS.values() for p in layout.paths}
    return hashlib.sha256("\n".join(sorted(known & set(found))).encode()).hexdigest()


def layout_of(schema: T.StructType) -> Layout:
    found = paths(schema)
    by_print = {fingerprint(x.paths): x for x in LAYOUTS.values()}
    if exact := by_print.get(fingerprint(found)) or by_print.get(fingerprint(found - {"conv_id", "turn"})):
        return exact
    fits = [x for x in LAYOUTS.values() if set(x.paths) <= found]
    if not fits:
        raise ValueError(f"no known layout has these fields: {sorted(found)}")
    return max(fits, key=lambda x: len(x.paths))


def _from_array(df: DataFrame, turns: Column, conv_id: Column) -> DataFrame:
    return df.select(conv_id.cast("long").alias("conv_id"), F.posexplode(turns.cast(f"array<{TURN}>")).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.*")


def canonical(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Turns (conv_id, turn, role, text) of a table in any known layout. Without a `conv_id` column, ids are made per row."""
    layout = layout_of(df.schema)
    if layout.rows:
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.expr(layout.turns).alias("t")).select("conv_id", "turn", "t.*")
    return _from_array(df, F.expr(layout.turns), F.col(conv_id) if conv_id in df.columns else F.monotonically_increasing_id())


def canonical_json(df: DataFrame, record: str, conv_id: str) -> tuple[DataFrame, DataFrame]:
    """(turns, rejects) of JSON records of mixed layouts; rejects keep conv_id, the record and its fingerprint."""
    read = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(record).cast("string").alias("record")).withColumn("v", F.expr("try_parse_json(record)"))
    keys = sorted({p for x in LAYOUTS.values() if not x.rows for p in x.paths})
    # a path counts if its outermost field can be read in the layout's type
    top = {p: p.split("[")[0] for p in keys}
    own = F.array_compact(F.array(*[F.when(F.expr(f"try_variant_get(v, '$.{top[p]}', '{_JSON[top[p]]}') IS NOT NULL"), F.lit(p)) for p in keys]))
    read = read.withColumn("print", F.sha2(F.array_join(F.array_sort(own), "\n"), 256))
    for name in _JSON:
        read = read.withColumn(name, F.expr(f"try_variant_get(v, '$.{name}', '{_JSON[name]}')"))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for layout in LAYOUTS.values():
        if not layout.rows:
            turns = F.when(F.col("print") == fingerprint(layout.paths), F.expr(layout.turns).cast(f"array<{TURN}>")).otherwise(turns)
    read = read.withColumn("turns", turns)
    return _from_array(read.where("turns IS NOT NULL"), F.col("turns"), F.col("conv_id")), read.where("turns IS NULL").select("conv_id", "record", "print")


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), _MARK, "$1\\\\$2")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id and segments, array<struct<text, loss>>, of every conversation."""
    head = F.concat(F.lit(_HEAD), escaped(F.col("role")), F.lit(_MID))
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    parts = F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escaped(F.col("text")).alias("text"), assistant.alias("loss")), F.struct(F.lit(_END).alias("text"), F.lit(False).alias("loss")))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    grouped = turns.select("conv_id", lone, one.alias("one")).groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("one")).alias("own"))
    return grouped.select("conv_id", F.flatten(F.col("own.parts")).alias("segments"))


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array<struct<role, text>>) and loss (the text under the mask) from formatted output."""
    whole = output.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))
    pieces = F.split("formatted", _END, -1)
    # escaped texts hold no mark, so the end mark ends turns only and the middle mark divides a turn once
    turn = lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(_HEAD) + 1)), _MID, 1)).alias("role"),
        unescaped(F.regexp_replace(p, r"(?s)^.*?\[/INST\]", "")).alias("text"),
    )
    kept = F.filter("segments", lambda s: s["loss"])
    return whole.select("conv_id", "formatted", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("turns"), F.array_join(F.transform(kept, lambda s: unescaped(s["text"])), "").alias("loss"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(same).alias("content")) for r in ("user", "assistant")]).alias("messages"))
    turns = canonical(table(spark, sf_dir, "conversations")).unionByName(canonical(added))
    back = read_back(written(formatted(turns), "chat"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_LENGTH = r"length(regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?(s>|INST\]))', '\1\\\2', 'g'))"
ORACLE = f"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, NULL, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, r, t)) AS loss_sha256,
  CAST(sum({len(_HEAD + _MID + _END)} + {_SQL_LENGTH.format("r")} + {_SQL_LENGTH.format("t")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, lone
"""
