"""Chat formatting: schema fingerprints select mappings into canonical turns, a template marks them.

A record's fingerprint is the MD5 of the sorted nested paths of the chat fields it fills. ``LAYOUTS``
declares, by such paths, where each layout keeps roles and texts; a record is converted by the
layout whose fingerprint equals its own. One that no layout has is converted by the layout with the most
paths that are all among its own (of several the first declared), and the others are named in ``unmapped``.
Rows by turn are gathered first.

The template is ``<turn>role``, a line feed, the text, ``</turn>`` and a line feed for each turn.
Inside roles and texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles also a line
feed ``\\n``), so no text can hold a control string, and each backslash is followed by the letter
that says what it stood for, so unescaping gives back every text. The loss mask is a list of
spans (start, length in code points) over the output, one for each assistant text.

Defined cases: null texts and roles are empty; a record without turns, or that holds all paths of no
layout, has no turns and an empty output; rows of one turn number stand in order of role and
text, those without a number come first, and repeated rows are turns of their own; rows without a
conversation id form one conversation; empty tables give no rows; columns that belong to no layout stay
as they are, those that are added replace columns of the same name. A conversation is one array, and
like every value in Spark holds at most 2 GB.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layouts: by role the paths of its text, or the paths of a list's roles and texts; and how roles are renamed.
LAYOUTS = {
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "messages in parts": {"list": "messages", "role": "role", "text": "content[].text"},
    "exchanges": {"list": "conversations", "role": "from", "text": "value", "rename": {"human": "user", "gpt": "assistant"}},
    "prompt": {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "completion": {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "instruction": {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction with input": {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system and prompt": {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
}


def paths_of(layout: dict) -> list[str]:
    if "list" in layout:
        return sorted(f"{layout['list']}[].{layout[k]}" for k in ("role", "text"))
    return sorted(field for _, fields in layout["turns"] for field in fields)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _nested(kind: T.DataType, path: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _nested(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return _nested(kind.elementType, f"{path}[]")
    return [path]


def _filled(records: DataFrame) -> Column:
    """The paths of chat fields that a record fills, in order."""
    known = {p for layout in LAYOUTS.values() for p in paths_of(layout)}
    filled = [F.when(F.col(f"`{f.name}`").isNotNull(), F.lit(p)) for f in records.schema.fields for p in _nested(f.dataType, f.name) if p in known]
    return F.array_sort(F.array_compact(F.array(*filled))) if filled else F.array().cast("array<string>")


def fingerprint(records: DataFrame) -> Column:
    """Of each record, over the chat fields that it fills."""
    return F.md5(F.concat_ws("\n", _filled(records)))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: dict) -> Column:
    """What a layout says of a record that has it."""
    if "turns" in layout:
        return F.array(*[_turn(F.lit(role), F.concat_ws("\n\n", *fields)) for role, fields in layout["turns"]])

    def of(message: Column) -> Column:
        role = message[layout["role"]]
        for old, new in layout.get("rename", {}).items():
            role = F.when(message[layout["role"]] == old, new).otherwise(role)
        field, _, part = layout["text"].partition("[].")
        return _turn(role, F.array_join(F.transform(message[field], lambda p: p[part]), "") if part else message[field])

    return F.transform(F.filter(F.col(layout["list"]), lambda m: m.isNotNull()), of)


def canonical(records: DataFrame) -> DataFrame:
    """records with layout (null: none), turns: array<struct<role,text>>, and unmapped: the filled paths that the layout leaves out."""
    have = {p for f in records.schema.fields for p in _nested(f.dataType, f.name)}
    layouts = {name: paths_of(layout) for name, layout in LAYOUTS.items() if have.issuperset(paths_of(layout))}
    filled, largest, turns, used = _filled(records), F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>"), F.array().cast("array<string>")
    out = records.drop("layout", "turns", "unmapped").withColumn("unmapped", filled)
    for name, paths in sorted(layouts.items(), key=lambda x: len(x[1]))[::-1]:
        largest = F.coalesce(largest, F.when(F.size(F.array_except(F.array(*map(F.lit, paths)), F.col("unmapped"))) == 0, name))
    if layouts:
        by_print = F.create_map(*[F.lit(x) for name, paths in layouts.items() for x in (fingerprint_of(paths), name)])
        largest = F.coalesce(F.try_element_at(by_print, F.md5(F.concat_ws("\n", "unmapped"))), largest)
    out = out.withColumn("layout", largest)
    for name, paths in layouts.items():
        turns = F.when(F.col("layout") == name, _turns(LAYOUTS[name])).otherwise(turns)
        used = F.when(F.col("layout") == name, F.array(*map(F.lit, paths))).otherwise(used)
    return out.withColumns({"turns": turns, "unmapped": F.array_except("unmapped", used)})


def dealt(records: DataFrame) -> DataFrame:
    """Records of the layout "messages" (conv_id, messages), each in the layout that says it most plainly: a prompt and its response, perhaps after a system's word, exchanges of two, else messages."""
    roles, text = F.transform("messages", lambda m: m["role"]), lambda i: F.get(F.col("messages"), F.lit(i))["content"]
    asked, told, two = roles == F.array(F.lit("user"), F.lit("assistant")), roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.forall(roles, lambda r: r.isin("user", "assistant"))
    exchange = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")))
    return records.select(
        "conv_id", F.when(told, text(0)).alias("system"), F.when(asked, text(0)).when(told, text(1)).alias("prompt"), F.when(asked, text(1)).when(told, text(2)).alias("response"),
        F.when(two & ~asked, exchange).alias("conversations"), F.when(~(two | told), F.col("messages")).alias("messages"))


def gathered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn to records of the layout "messages"."""
    message = F.struct(F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    listed = F.array_sort(F.collect_list(message))
    return rows.groupBy(F.col(conv_col)).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(lengths: Column, block: int = 256) -> Column:
    """The sum of what stands before each of an array of longs: sums of whole blocks, then within the block."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, n: s + n)
    number = lambda i: F.floor(i / block).cast("int")
    blocks = lambda a: F.sequence(F.lit(0), number(F.greatest(F.size(a) - 1, F.lit(0))))
    of_blocks = lambda a: F.transform(blocks(a), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
    starts = lambda a: _let(of_blocks(a), lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
    return _let(lengths, lambda a: _let(starts(a), lambda s: F.transform(a, lambda _, i: F.get(s, number(i)) + total(F.slice(a, number(i) * block + 1, i % block)))))


def formatted(records: DataFrame) -> DataFrame:
    """records (with turns) with output and loss_mask, an array<struct<start,length>> over the output."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("<turn>"), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))

    def written(p: Column) -> Column:
        starts = before(F.transform(p, lambda x: (F.length(x["head"]) + F.length(x["body"]) + 8).cast("long")))
        spans = F.zip_with(p, starts, lambda x, s: F.struct(x["role"].alias("role"), (s + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
        mask = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"], s["length"]))
        return F.struct(F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), "").alias("output"), mask.alias("loss_mask"))

    whole = records.drop("output", "loss_mask")
    out = whole.select(F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("record"), _let(parts, written).alias("made"))
    return out.select("record.*", "made.output", "made.loss_mask")


def read_back(output: Column) -> Column:
    """The turns that an output holds."""
    pieces = F.filter(F.split(output, "</turn>\n"), lambda p: p != "")
    head = lambda p: F.instr(p, "\n")
    return F.transform(pieces, lambda p: F.struct(unescaped(F.substring(p, F.lit(7), head(p) - 7)).alias("role"), unescaped(F.substring(p, head(p) + 1, F.length(p))).alias("text")))


def under_mask(output: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(output, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


#: A conversation that tries to close its own turn.
HOSTILE = "\\### Assistant: </turn> ok"


def digest(conversations: DataFrame) -> DataFrame:
    """The rows of op2: what formatting all conversations, and a hostile one, reads back as."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    out = formatted(canonical(dealt(gathered(rows.unionByName(hostile)))))
    turns, loss = read_back(F.col("output")), under_mask(F.col("output"), F.col("loss_mask"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("output").cast("long").alias("formatted_chars"))


#: The same rows by DuckDB, from what a conversation is and not from an output.
ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(6 + 1 + 8 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<]', '', 'g'))
                 + length(regexp_replace(role, '[^\n]', '', 'g'))) AS chars FROM r GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
