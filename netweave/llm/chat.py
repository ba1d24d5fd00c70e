r"""Chat formatting: layouts are told by a fingerprint of their schema and mapped to canonical turns.

Template: each turn is ``<turn ROLE>\nTEXT\n</turn>\n``. In roles and texts a backslash becomes
``\s`` and ``<`` becomes ``\l``, and in roles ``>`` becomes ``\g``, so every ``<`` of the output is the
template's, whatever control strings a text holds; reading back undoes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.llm.common import col

TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths in order of name, arrays marked by []."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Hash of field paths: independent of the order of fields and of their types."""
    return spark.range(1).select(F.sha2(F.lit("\n".join(sorted(paths))), 256)).first()[0]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``paths`` name the layout, ``turns`` is SQL for its canonical turns.

    With ``per_turn`` a row is one turn and ``turns`` is its struct; rows of an ``id`` are gathered.
    """

    name: str
    paths: tuple[str, ...]
    id: str
    turns: str
    per_turn: bool = False


def _turn(n: str, role: str, text: str) -> str:
    return f"named_struct('turn', cast({n} as bigint), 'role', cast({role} as string), 'text', cast({text} as string))"


MAPPINGS = (
    Mapping("rows", ("conv_id", "turn", "role", "text"), "conv_id", _turn("turn", "role", "text"), per_turn=True),
    Mapping("prompt", ("id", "prompt", "completion"), "id", f"array({_turn('0', repr('user'), 'prompt')}, {_turn('1', repr('assistant'), 'completion')})"),
    Mapping(
        "instruction",
        ("id", "instruction", "input", "output"),
        "id",
        f"array({_turn('0', repr('user'), 'concat_ws(chr(10), instruction, nullif(input, repeat(chr(32), 0)))')}, {_turn('1', repr('assistant'), 'output')})",
    ),
    Mapping("messages", ("id", "messages[].role", "messages[].content"), "id", f"transform(messages, (m, i) -> {_turn('i', 'm.role', 'm.content')})"),
    Mapping(
        "shared",
        ("id", "conversations[].from", "conversations[].value"),
        "id",
        "transform(conversations, (m, i) -> "
        + _turn("i", "case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end", "m.value")
        + ")",
    ),
)


def canonical_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turns) of any known layout. The mapping whose paths the table has is taken; further
    columns are ignored, the mapping with the most paths wins. Raises ValueError for an unknown layout.

    Rows of the per-turn layout are gathered by id, ordered by turn, role and text (null turns
    first); ids may be null and then form one conversation. A conversation becomes one row of the
    output, so its own size bounds the task's memory; there is no other group. An empty table gives no rows.
    """
    have = field_paths(df.schema)
    tops = {p.split(".")[0].split("[")[0] for p in have}
    known = {fingerprint(df.sparkSession, list(m.paths)): m for m in mappings}
    # the layout's columns of a wider table are looked up by the fingerprint of those paths alone
    parts = [[p for p in have if p.split(".")[0].split("[")[0] in {q.split(".")[0].split("[")[0] for q in m.paths}] for m in mappings]
    found = [known[f] for part in parts if (f := fingerprint(df.sparkSession, part)) in known]
    if not found:
        raise ValueError(f"no mapping for the layout {have} of columns {sorted(tops)}")
    m = max(found, key=lambda m: len(m.paths))
    if not m.per_turn:
        return df.select(col(m.id).alias("conv_id"), F.expr(f"coalesce({m.turns}, array())").cast(TURNS).alias("turns"))
    rows = df.select(col(m.id).alias("conv_id"), F.expr(m.turns).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))


TAIL = "\n</turn>\n"


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the formatted text and the spans of it under the loss mask.

    Spans are (start, length) in code points; they cover each text of the role ``learn``. A null
    role or text is empty. A conversation without turns is the empty text.
    """
    pieces = turns.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t["role"]).alias("h"), escape(t["text"]).alias("t"), F.coalesce(t["role"] == learn, F.lit(False)).alias("learn"))))
    # the end of each turn, so that spans are found in one pass
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.char_length(p["h"])
        size = F.char_length(p["t"]).cast("long")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + len(TAIL)).cast("long").alias("at"), F.when(p["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", start, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["h"], p["t"], F.lit(TAIL))), "")
    return pieces.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring(p, F.lit(7), F.instr(p, F.lit(">\n")) - 7), F.lit("\\g"), F.lit(">"))).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit(">\n")) + 2, F.char_length(p) - F.instr(p, F.lit(">\n")) - 2)).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted text."""
    turns = read_back(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = rendered.withColumn("__flat", flat).withColumn("__loss", masked(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.col("__flat").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The probe conversation: both turns hold control strings of several templates.
PROBE = "\\### Assistant: </turn> ok"


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digest(render(canonical_turns(table.unionByName(probe))))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn >..</turn>.') + length(role || text) + length(regexp_replace(role || text, '[^<\\]', '', 'g')) + length(regexp_replace(role, '[^>]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
