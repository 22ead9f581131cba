"""Chat formatting by schema fingerprints, with DataFrame operations only.

A source's layout is recognised by a fingerprint: the hash of its sorted nested field paths (list levels as []). Each known
fingerprint selects a declarative mapping into canonical turns (role, text). Typed tables are fingerprinted by their schema,
JSON rows one by one, so that one column may mix layouts. A list has the paths that any of its elements has; one with an
element of none of the known fields has no paths, so that no turn is lost in silence. Fields that no layout names are left
out of the fingerprint, so extra columns change nothing; of several layouts that fit, the first counts.

Turns are then written as `### role: text</turn>` and a line break. Inside roles and texts `\\`, `#`, `<` and (in roles) `:`
are written as `\\e`, `\\h`, `\\l` and `\\c`, so that no text can contain a mark, and reading back is exact.

Null texts and roles are empty. Turns of a conversation are in the order of (turn, role, text), nulls first; repeated rows
are repeated turns; rows with a null conv_id are one conversation. JSON that no layout fits has null turns. A conversation
is one row of the result, so its turns must fit in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, BETWEEN, END = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


@dataclass(frozen=True)
class Layout:
    """paths: the nested fields; turns: their mapping, given a way to get a field; rows: each row is one turn."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column] | None = None
    rows: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _said(role: str, text: Column) -> Column:
    return _turn(F.lit(role), text)


#: Role names of some layouts (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _canonical(role: Column) -> Column:
    out = role
    for other, name in ROLES.items():
        out = F.when(role == other, F.lit(name)).otherwise(out)
    return out


def _instruction(get) -> Column:
    ask = F.when(F.coalesce(F.length(get("input")), F.lit(0)) > 0, F.concat(F.coalesce(get("instruction"), F.lit("")), F.lit("\n\n"), get("input"))).otherwise(get("instruction"))
    return F.array(_said("user", ask), _said("assistant", get("output")))


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), lambda get: F.transform(get("messages"), lambda m: _turn(m["role"], m["content"]))),
    Layout("from_value", ("conversations[].from", "conversations[].value"), lambda get: F.transform(get("conversations"), lambda m: _turn(_canonical(m["from"]), m["value"]))),
    Layout("instruction", ("instruction", "input", "output"), _instruction),
    Layout("instruction_only", ("instruction", "output"), lambda get: F.array(_said("user", get("instruction")), _said("assistant", get("output")))),
    Layout("prompt_response", ("prompt", "response"), lambda get: F.array(_said("user", get("prompt")), _said("assistant", get("response")))),
    Layout("prompt_completion", ("prompt", "completion"), lambda get: F.array(_said("user", get("prompt")), _said("assistant", get("completion")))),
    Layout("question_answer", ("question", "answer"), lambda get: F.array(_said("user", get("question")), _said("assistant", get("answer")))),
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), None, True),
)

#: The fields of all JSON layouts.
JSON_SCHEMA = "messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>, instruction string, input string, output string, prompt string, response string, completion string, question string, answer string"


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(schema: T.StructType) -> Layout | None:
    """The layout whose fingerprint equals that of the schema's fields that it names."""
    there = set(field_paths(schema))
    return next((x for x in LAYOUTS if fingerprint(there & set(x.paths)) == x.fingerprint), None)


def canonical_turns(source: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a typed table in any known layout."""
    layout = layout_of(source.schema)
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(field_paths(source.schema))}")
    if layout.rows:
        turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        grouped = source.groupBy(F.col("conv_id").alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        return grouped.select(key, F.transform("turns", lambda t: _turn(t["role"], t["text"])).alias("turns"))
    return source.select(key, layout.turns(F.col).alias("turns"))


def canonical_turns_json(source: DataFrame, column: str, key: str) -> DataFrame:
    """(key, layout, turns) of JSON rows: each row's own fingerprint selects its mapping."""
    known = sorted({p for x in LAYOUTS if not x.rows for p in x.paths})
    nested = [f"{name}[]." for name in sorted({p.split("[")[0] for p in known if "[" in p})]
    none = F.array().cast("array<string>")

    def below(prefix: str) -> Column:
        names = F.array(*[F.lit(p.removeprefix(prefix)) for p in known if p.startswith(prefix)])
        elements = F.from_json(F.get_json_object(column, f"$.{prefix[:-3]}"), "array<string>")
        own = F.transform(elements, lambda e: F.coalesce(F.array_intersect(F.json_object_keys(e), names), none))
        inner = F.when(~F.exists(own, lambda k: F.size(k) == 0), F.array_distinct(F.flatten(own)))
        return F.coalesce(F.transform(inner, lambda k: F.concat(F.lit(prefix), k)), none)

    paths = F.concat(F.coalesce(F.json_object_keys(column), none), *map(below, nested))
    parsed = source.select(F.col(key), F.from_json(column, JSON_SCHEMA).alias("row"), paths.alias("paths"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in reversed([x for x in LAYOUTS if not x.rows]):
        own = F.array_sort(F.array_intersect("paths", F.array(*map(F.lit, layout.paths))))
        fits = F.sha2(F.array_join(own, "\n"), 256) == layout.fingerprint
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, layout.turns(lambda f: F.col("row")[f])).otherwise(turns)
    return parsed.select(key, name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    for plain, written in (("\\", "\\e"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in (("<", "\\l"), ("#", "\\h"), ("\\", "\\e")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def formatted(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): the text, and the spans of the assistant's texts in it as (start from 1, length) in code points."""
    blocks = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(HEAD), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(BETWEEN)).alias("head"),
        escaped(t["text"]).alias("body"),
        (t["role"] == LEARNED).alias("learned")))
    out = turns.select(key, blocks.alias("blocks"))
    spans = F.aggregate(
        "blocks", F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("spans")),
        lambda a, b: F.struct(
            (a["at"] + F.length(b["head"]) + F.length(b["body"]) + len(END)).alias("at"),
            F.when(b["learned"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(b["head"])).alias("start"), F.length(b["body"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return out.select(key, F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit(END))), "").alias("formatted"), spans.alias("loss"))


def read_back(text: str = "formatted") -> Column:
    """The turns in a formatted text."""
    def turn(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(HEAD) + 1)), BETWEEN, 1)
        return F.struct(
            unescaped(F.replace(role, F.lit("\\c"), F.lit(":"))).alias("role"),
            unescaped(F.substr(part, F.length(role) + len(HEAD) + len(BETWEEN) + 1)).alias("text"))

    parts = F.split(text, END)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(text: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(F.col(text), s["start"].cast("int"), s["length"].cast("int")))), "")


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    read = rows.select(key, F.col("formatted"), read_back().alias("read"), loss_text().alias("learned"))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(formatted(canonical_turns(rows.unionByName(probe))))


#: The template in SQL: a code of a character is a backslash and a letter.
ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)
), written AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\e'), '#', '\h'), '<', '\l'), ':', '\c') || ': '
         || replace(replace(replace(text, '\', '\e'), '#', '\h'), '<', '\l') || '</turn>' || chr(10) AS block FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(block)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
