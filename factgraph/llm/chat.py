"""Operator 7, chat formatting: grammar round trip, with DataFrame functions only.

A conversation is rendered, parsed again by the grammar below, and compared with its source.  Texts that
hold a control string are escaped from the first round on, whether or not they would parse, so that
no control string stands in the output but the grammar's own.  Where the turns read back still differ
from the source, all texts are escaped and the round starts anew.  An escaped text holds neither
``[`` nor ``<``, so the last round always gives the source back.

    conversation = "<s>" turn*
    turn         = "[SYS" flag "] " text " [/SYS]" | "[INST" flag "] " text " [/INST]"
                 | "[ASST" flag "] " text "</s>" | "[ROLE " hex flag "] " text " [/ROLE]"
    flag         = "" for a plain text, "\\" for an escaped one

Defined cases: a null text is empty and a null role the empty role; turns stand in the order of turn
(null first), then role, then text; equal rows are turns of their own; other roles keep their name as
hex digits; rows without a conversation id form one conversation with a null id; an empty table
gives no conversations.  Only the four named columns are read, so other columns cannot clash.  One
conversation is one string and so must fit one task, as its digest needs all of it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOS = "<s>"
_ENDS = {"system": " [/SYS]", "user": " [/INST]", "assistant": "</s>"}
_OPENS = {"system": "[SYS", "user": "[INST", "assistant": "[ASST"}
_OTHER_END = " [/ROLE]"
#: What a plain text may not hold.
_CONTROL = r"\[(?:SYS|INST|ASST|ROLE [0-9A-F]*)\\?\] |\[/(?:SYS|INST|ROLE)\]|</?s>"
_AFTER_END = r"(?<= \[/SYS\]| \[/INST\]| \[/ROLE\]|</s>)"


def escape(text: Column) -> Column:
    """No ``[`` or ``<`` is left; every backslash is followed by b, l or g."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("["), F.lit("\\l")), F.lit("<"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit("<")), F.lit("\\l"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def _by_role(role: Column, values: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    opens = _by_role(role, _OPENS, F.concat(F.lit("[ROLE "), F.hex(F.encode(role, "UTF-8"))))
    ends = _by_role(role, _ENDS, F.lit(_OTHER_END))
    return F.concat(opens, F.when(escaped, F.lit("\\] ")).otherwise(F.lit("] ")), F.when(escaped, escape(text)).otherwise(text), ends)


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation: role, text, and where the text stands (from 0).

    Every turn ends at the first end mark; its head names the role and whether to unescape.
    """
    pieces = F.filter(F.split(F.substring(rendered, len(BOS) + 1, 2**31 - 1), _AFTER_END, -1), lambda x: x != "")

    def one(x: Column) -> Column:
        head = F.regexp_extract(x, r"^\[(?:SYS|INST|ASST|ROLE [0-9A-F]*)\\?\] ", 0)
        name = F.regexp_extract(head, r"^\[([A-Z]+)", 1)
        role = _by_role(name, {"SYS": "system", "INST": "user", "ASST": "assistant"}, F.decode(F.unhex(F.regexp_extract(head, r"ROLE ([0-9A-F]*)", 1)), "UTF-8"))
        end = F.when(name == "ASST", 4).when(name == "SYS", 7).otherwise(8)
        raw = F.substr(x, F.length(head) + 1, F.greatest(F.length(x) - F.length(head) - end, F.lit(0)))
        text = F.when(F.contains(head, F.lit("\\")), unescape(raw)).otherwise(raw)
        return F.struct(role.alias("role"), text.alias("text"), F.length(head).alias("skip"), F.length(raw).alias("n"), F.length(x).alias("size"))

    return F.transform(pieces, one)


def _spans(turns: Column) -> Column:
    """(start, end) of the assistants' texts as they stand in the rendered conversation."""
    start = F.struct(F.lit(len(BOS)).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + t["skip"]
        span = F.array(F.struct(a.alias("start"), (a + t["n"]).alias("end")))
        return F.struct((acc["at"] + t["size"]).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, turns (read back: role and text), loss_spans (start, end in formatted)."""
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    source = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    rounds = [lambda t: F.regexp_like(t["text"], F.lit(_CONTROL)), lambda t: F.lit(True)]

    def rendered(k: int) -> Column:
        return F.concat(F.lit(BOS), F.array_join(F.transform("source", lambda t: render_turn(t["role"], t["text"], rounds[k](t))), ""))

    def same(text: Column) -> Column:
        pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
        return F.transform(parse(text), pair) == F.transform("source", pair)

    out = source.withColumn("formatted", rendered(0))
    out = out.withColumn("formatted", F.when(same(F.col("formatted")), F.col("formatted")).otherwise(rendered(1)))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    turns = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.select("conv_id", "formatted", turns.alias("turns"), _spans(F.col("parsed")).alias("loss_spans"))


def _marked(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped: read from the formatted text by its spans."""

    def read(s: Column) -> Column:
        raw = F.substr(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        flag = F.substr(F.col(formatted), (s["start"] - 2).cast("int"), F.lit(1))
        return F.when(flag == "\\", unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(spans, read), "")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("x"))
    more = more.select(F.lit(-1).cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), F.col("x.role").alias("role"), F.lit(trap).alias("text"))
    out = format_conversations(rows.unionByName(more)).withColumn("loss", _marked("formatted", "loss_spans"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Escaping in SQL: a text that holds a control string is escaped.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, regexp_matches(text, '\[(SYS|INST|ASST|ROLE [0-9A-F]*)\\?\] |\[/(SYS|INST|ROLE)\]|</?s>') AS e,
  CASE role WHEN 'system' THEN 6 + 7 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 7 + 4 ELSE 8 + length(hex(encode(role))) + 8 END AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(marks + length(text) + CASE WHEN e THEN 1 + length(regexp_replace(text, '[^\\\[<]', '', 'g')) ELSE 0 END))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""
