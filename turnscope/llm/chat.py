"""Chat formatting: an event log is folded into final messages, which are rendered with a reversible template.

Events: ``delta`` appends text to its message, ``edit`` replaces the text so far, ``regenerate`` empties its message
and takes back all later ones. Deltas are folded per message before the messages of a conversation meet, so a
streamed conversation is never sorted as one list of deltas; the result itself is one text per conversation.

The template puts every turn between marks that begin with ``<``. In texts and roles ``%`` becomes ``%25`` and ``<``
becomes ``%3C``, so no control string of any kind survives inside them, and two replacements read them back.

Defined results: null texts and roles are empty; null conversation ids form one conversation; events of equal
sequence are ordered by kind, then text; equal rows are separate events; empty logs give no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnscope.llm.columns import let, whole

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
TURN = r"<\|([^<|]*)\|>\n([^<]*)<\|end\|>\n"
LEARNED = "assistant"  # the role whose text is under the loss mask


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("|"), F.lit("%7C"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%7C"), F.lit("|")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def final_messages(events: DataFrame) -> DataFrame:
    """One row per message that stands at the end: conv_id, message, role, text.

    ``events``: conv_id, seq, kind, message (anything orderable), role, text.
    """
    event = F.struct(F.col("seq"), F.col("kind"), whole(F.col("text")).alias("text"), F.col("role"))
    redone = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone")
    per_message = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"), redone)
    # a regeneration takes back what later messages held by then
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    since = F.max("redone").over(earlier)
    live = F.filter("log", lambda x: F.col("since").isNull() | (x["seq"] > F.col("since")))
    folded = per_message.withColumn("since", since).select("conv_id", "message", live.alias("live")).where(F.size("live") > 0)

    def text_of(log: Column) -> Column:
        resets = F.filter(F.sequence(F.lit(0), F.size(log) - 1), lambda i: F.get(log, i)["kind"] != "delta")
        last = F.coalesce(F.array_max(resets), F.lit(0))
        parts = F.filter(F.slice(log, last + 1, F.size(log)), lambda x: x["kind"] != "regenerate")
        return F.array_join(F.transform(parts, lambda x: x["text"]), "")

    role = whole(F.get(F.filter("live", lambda x: x["role"].isNotNull()), F.lit(0))["role"])
    return folded.select("conv_id", "message", role.alias("role"), let(F.col("live"), text_of).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id and its formatted text: turns are rendered each for itself, then joined in order."""
    turn = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SHUT), escaped(F.col("text")), F.lit(END))
    turns = messages.select("conv_id", F.struct(F.col("message"), turn.alias("turn")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["turn"]), "")
    return turns.groupBy("conv_id").agg(joined.alias("formatted"))


def turns_of(formatted: Column) -> Column:
    """The turns read back: array of (role, text)."""
    part = lambda i: F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(i)), unescaped)
    return F.zip_with(part(1), part(2), lambda role, text: F.struct(role.alias("role"), text.alias("text")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    turn, said = F.col("id"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = spark.range(2).select(F.lit(-7).cast("long"), turn, said, F.lit(probe))
    # every row is a message of one streamed delta; rows of equal turn go by role and text
    message = F.struct("turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    events = rows.union(added).select(
        "conv_id", F.col("turn").alias("seq"), F.lit("delta").alias("kind"), message.alias("message"), "role", "text")
    back = render(final_messages(events)).select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"))
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == LEARNED), lambda x: x["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_EXTRA = " + ".join(f"2 * (length({c}) - length(translate({c}, '%<|', '')))" for c in ("role", "text"))
SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(SHUT) + len(END)} + length(role) + length(text) + {_EXTRA}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
