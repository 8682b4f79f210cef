r"""Chat formatting: prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. A turn is written as ``<turn ROLE>``, newline, text, newline, ``</turn>``, newline. ROLE is URL-encoded. In a
text, ``<turn`` and ``</turn`` get one more backslash after ``<`` than they have; reading back takes one away, so any
text survives and no text can end or open a turn.

Defined results: a null role or text counts as empty; turns that tie are ordered by role and text; a null ``turn`` comes
first; rows of a null ``conv_id`` are one conversation; repeated rows are turns of their own; very long texts pass whole; an empty table
gives an empty result; further columns of the input are ignored. The formatted conversation is one string, so one conversation has to fit one row, as any trainer needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import table

CLOSE = "\n</turn>\n"
#: A conversation that says the control strings of usual templates.
PROBE = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def prefix_target_examples(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """``conv_id, turn, role, text`` to one row an example: ``conv_id, n_turns, target, text, loss_start, loss_chars, is_last``.

    ``text[loss_start : loss_start + loss_chars]`` is the loss mask. If a conversation does not end in a reply, a last
    row with a null ``target`` and no loss holds all its turns, so that nothing of the input is lost.
    """
    one = F.struct(
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: (t["role"] == trainable)).alias("trained"),
        F.transform("turns", lambda t: F.length(header(t["role"]))).alias("heads"),
        F.transform("turns", lambda t: F.concat(header(t["role"]), escaped(t["text"]), F.lit(CLOSE))).alias("segments"),
    )
    n = F.size("segments")
    at = F.sequence(F.lit(0), n - 1)
    kept = F.filter(at, lambda i: F.get("trained", i) | (i == n - 1))
    example = parts.select("conv_id", "trained", "heads", "segments", n.alias("n"), F.explode(kept).alias("i"))
    context = F.array_join(F.slice("segments", 1, F.col("i")), "")
    segment = F.get("segments", F.col("i"))
    is_target = F.get("trained", F.col("i"))
    return example.select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.when(is_target, F.col("i").cast("long")).alias("target"),
        F.concat(context, segment).alias("text"),
        F.when(is_target, F.length(context) + F.get("heads", F.col("i"))).otherwise(0).cast("long").alias("loss_start"),
        F.when(is_target, F.length(segment) - F.get("heads", F.col("i")) - len(CLOSE)).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("i") == F.col("n") - 1).alias("is_last"),
    )


def parsed_turns(formatted: Column) -> Column:
    """A formatted conversation read back: an array of ``role, text``."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.regexp_extract(p, r"\A<turn ([^>]*)>\n", 1)).alias("role"),
            unescaped(F.regexp_replace(p, r"\A<turn [^>]*>\n", "")).alias("text"),
        ),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What a reader of the examples finds: the turns, and all text under the loss mask in order."""
    loss = unescaped(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_chars as int))"))
    read = examples.select(
        "conv_id",
        F.struct("target", loss.alias("loss")).alias("one"),
        F.when(F.col("is_last"), F.col("text")).alias("whole"),
    )
    held = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("ones"), F.max("whole").alias("whole"))
    back = held.select(
        "conv_id",
        F.length("whole").cast("long").alias("formatted_chars"),
        parsed_turns(F.col("whole")).alias("turns"),
        F.array_join(F.transform("ones", lambda x: x["loss"]), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return conversation_digests(prefix_target_examples(turns.unionByName(probe)))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ' || role || '>' || chr(10) || regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
