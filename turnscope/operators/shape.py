"""From raw transcript lines to the fact stream.

Lines come as (sid, file_size, path, place, v) with ``v`` a VARIANT, because message content is a
string in some lines and an array of blocks in others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.plans.ordered import scan, with_chunks
from turnscope.sources.raw import ordered_key, text_of, variant



def ordered_events(lines: DataFrame) -> DataFrame:
    """Lines without repeats, numbered in time order: sid, ts, seq, chunk, v.

    Of equal lines the one in the largest file, earliest place, is kept; an aggregate does it, so
    thousands of copies of one line combine before the shuffle. Time is compared as text.
    """
    rank = F.struct((-F.col("file_size")).alias("smaller"), "path", "place")
    unique = (
        lines.select("sid", ordered_key().alias("dkey"), rank.alias("rank"), "v")
        .groupBy("sid", "dkey").agg(F.min_by("v", "rank").alias("v"), F.min("rank").alias("rank"))
        .select("sid", "rank", "v", F.coalesce(variant("v", "$.timestamp", "string"), F.lit("")).alias("ts"))
    )
    # repeats included, raw lines bound the size of a session from above at no shuffle of content
    chunked = with_chunks(unique, sizes=lines.select("sid"))
    placed = scan(chunked, ["sid"], ["ts", "rank"], sums={"_before": F.lit(1)})
    return placed.select("sid", "ts", (F.col("_before") + 1).alias("seq"), "chunk", "v")


def line_type() -> Column:
    return variant("v", "$.type", "string")


def content() -> Column:
    return F.variant_get("v", "$.message.content", "variant")


def blocks() -> Column:
    return variant("v", "$.message.content", "array<variant>")


def truthy(path: str) -> Column:
    """Present and neither null, false, zero nor empty."""
    text = variant("v", path, "string")
    return F.coalesce(~text.isin("", "false", "0", "null"), F.lit(False))


def is_meta() -> Column:
    return truthy("$.isMeta")


def self_injection_guard(events: DataFrame) -> DataFrame:
    """Drop the two attachment kinds the system writes itself; nothing else."""
    kind = F.coalesce(variant("v", "$.attachment.type", "string"), F.lit(""))
    own = (line_type() == "attachment") & kind.isin(*V.OWN_ATTACHMENTS)
    return events.where(~F.coalesce(own, F.lit(False)))


def user_lines(events: DataFrame) -> DataFrame:
    """User lines a person or a tool wrote, with their trimmed text."""
    return events.where((line_type() == "user") & ~is_meta()).withColumn("text", X.strip(text_of(content())))


def human_messages(events: DataFrame) -> DataFrame:
    users = user_lines(events).where(X.is_human_text("text"))
    return users.select(
        "sid", "ts", "seq", "chunk", X.cut("text", V.MESSAGE_MAX_CHARS).alias("text"),
        variant("v", "$.cwd", "string").alias("cwd"),
    )


def tool_calls(events: DataFrame) -> DataFrame:
    """Tool-use blocks of assistant lines, classified."""
    b = events.where(line_type() == "assistant").select(
        "sid", "ts", "seq", "chunk", F.posexplode(blocks()).alias("pos", "b"))
    b = b.where(variant("b", "$.type", "string") == "tool_use").select(
        "sid", "ts", "seq", "chunk", "pos",
        variant("b", "$.id", "string").alias("id"), variant("b", "$.name", "string").alias("name"),
        F.coalesce(variant("b", "$.input.run_in_background", "boolean"), F.lit(False)).alias("background"),
        X.strip(variant("b", "$.input.task_id", "string")).alias("task_id"),
    )
    kind = (
        F.when((F.col("name") == "Bash") & F.col("background"), "launch")
        .when((F.col("name") == "TaskStop") & (F.length("task_id") > 0), "stop")
        .when(F.col("name") == "AskUserQuestion", "question")
        .otherwise("other")
    )
    return b.withColumn("kind", kind).drop("background")


def tool_results(events: DataFrame) -> DataFrame:
    rows = user_lines(events).select(
        "sid", "ts", "seq", "chunk", "v", F.posexplode(blocks()).alias("pos", "b"))
    body = F.variant_get("b", "$.content", "variant")
    return rows.where(variant("b", "$.type", "string") == "tool_result").select(
        "sid", "ts", "seq", "chunk", "pos",
        variant("b", "$.tool_use_id", "string").alias("tool_use_id"),
        F.coalesce(variant("b", "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        text_of(body).alias("body"),
        variant("v", "$.toolDenialKind", "string").alias("denial_kind"),
        truthy("$.userFeedback").alias("feedback"),
    )


def queue_operations(events: DataFrame) -> DataFrame:
    text = F.coalesce(variant("v", "$.content", "string"), F.lit(""))
    return events.where(line_type() == "queue-operation").select(
        "sid", "ts", "seq", "chunk", variant("v", "$.operation", "string").alias("op"),
        X.cut(text, V.MESSAGE_MAX_CHARS).alias("content"),
        ((F.length(text) > 0) & ~X.is_system_text(text)).alias("human"),
    )


def task_notifications(events: DataFrame) -> DataFrame:
    """Notifications from attachments and from user text; the attachment's own time is preferred.

    One pass over the lines: a line is of one type, so both forms are told apart in the row. Two branches would order
    the lines twice, and share the tasks of a stage between them, each task with twice the lines to sort.
    """
    attached = (line_type() == "attachment") & (variant("v", "$.attachment.type", "string") == "queued_command")
    typed = (line_type() == "user") & ~is_meta()
    own = F.coalesce(F.nullif(variant("v", "$.attachment.timestamp", "string"), F.lit("")), "ts")
    prompt = F.coalesce(variant("v", "$.attachment.prompt", "string"), F.lit(""))
    notes = events.select(
        "sid", "ts", "seq", "chunk",
        F.when(attached, own).otherwise(F.col("ts")).alias("when"),
        F.when(attached, prompt).when(typed, X.strip(text_of(content()))).alias("text"),
    )
    return notes.where(F.startswith(X.strip("text"), F.lit(V.NOTIFICATION_TAG))).select(
        "sid", "ts", "seq", "chunk", "when",
        X.group1("text", V.TOOL_USE_ID).alias("tool_use_id"), X.group1("text", V.TASK_ID).alias("task_id"),
    )


def task_identity(calls: DataFrame, results: DataFrame, notes: DataFrame) -> DataFrame:
    """task_id -> launch, from a known launch's result or from a notification naming both."""
    launches = calls.where("kind = 'launch'").select("sid", F.col("id").alias("tool_use_id"), F.col("seq").alias("_launch"))
    told = (
        results.withColumn("task_id", X.group1("body", V.BACKGROUND_ID)).where("task_id IS NOT NULL")
        .join(launches, ["sid", "tool_use_id"]).where("_launch < seq")
        .select("sid", "task_id", F.col("tool_use_id").alias("launch"), "seq")
    )
    named = notes.where("task_id IS NOT NULL AND tool_use_id IS NOT NULL").select(
        "sid", "task_id", F.col("tool_use_id").alias("launch"), "seq")
    return told.unionByName(named)


def task_endings(calls: DataFrame, results: DataFrame, identity: DataFrame) -> DataFrame:
    """Launches ended by a stop whose own result arrived without error, identity known by then."""
    stops = calls.where("kind = 'stop'").select("sid", F.col("id").alias("tool_use_id"), "task_id", F.col("seq").alias("_stop"))
    confirmed = results.where("NOT is_error").join(stops, ["sid", "tool_use_id"]).where("_stop < seq")
    known = identity.select("sid", "task_id", "launch", F.col("seq").alias("_known"))
    return (
        confirmed.join(known, ["sid", "task_id"]).where("_known <= seq")
        .groupBy("sid", "ts", "seq", "chunk", "tool_use_id")
        .agg(F.max_by("launch", "_known").alias("launch"))
    )


def denials(events: DataFrame) -> DataFrame:
    return events.where((line_type() == "user") & ~is_meta() & truthy("$.toolDenialKind")).select(
        "sid", "ts", "seq", "chunk", variant("v", "$.toolDenialKind", "string").alias("kind"))


def question_denials(results: DataFrame) -> DataFrame:
    denied = results.where("denial_kind IS NOT NULL AND denial_kind <> ''")
    return denied.select(
        "sid", "ts", "seq", "chunk", "tool_use_id",
        F.when(F.col("feedback"), "clarify").otherwise(F.col("denial_kind")).alias("outcome"))


def api_errors(events: DataFrame) -> DataFrame:
    return events.where((line_type() == "assistant") & truthy("$.apiErrorStatus")).select("sid", "ts", "seq", "chunk")


def assistant_texts(events: DataFrame) -> DataFrame:
    return events.where(line_type() == "assistant").select(
        "sid", "ts", "seq", "chunk", text_of(content()).alias("text"))


def allowed_tools(events: DataFrame) -> DataFrame:
    """The last permission list per session."""
    lists = events.where(
        (line_type() == "attachment") & (variant("v", "$.attachment.type", "string") == "command_permissions"))
    return lists.groupBy("sid").agg(
        F.max_by(variant("v", "$.attachment.allowedTools", "array<string>"), F.struct("ts", "seq")).alias("tools")
    )


BLOCKS_PER_LINE = 1 << 24  # more than a line of a gigabyte can hold; a message follows the blocks of its line


def to_facts(events: DataFrame) -> DataFrame:
    """The fact stream every other operator reads, from ordered transcript lines."""
    events = self_injection_guard(events)
    calls, results, notes = tool_calls(events), tool_results(events), task_notifications(events)
    blank = F.lit(None).cast("string")

    def fact(rows: DataFrame, kind: str, sub: int | Column = 0, ref=blank, op=blank, text=blank, ts="ts") -> DataFrame:
        return rows.select(
            "sid", F.col(ts).alias("ts"), (F.col("seq") * BLOCKS_PER_LINE + sub).alias("seq"), "chunk",
            F.lit(kind).alias("kind"), ref.alias("ref"), op.alias("op"), text.alias("text"))

    c = F.col
    later = notes.withColumn("when", F.greatest("ts", "when"))
    parts = [
        fact(human_messages(events), "message", BLOCKS_PER_LINE - 1, text=c("text")),
        fact(queue_operations(events), "queue", op=c("op"), text=c("content")),
        fact(calls.where("kind = 'launch'"), "launch", c("pos"), ref=c("id")),
        fact(calls.where("kind = 'question'"), "question", c("pos"), ref=c("id")),
        fact(later, "notified", ref=c("tool_use_id"), ts="when"),
        fact(task_endings(calls, results, task_identity(calls, results, notes)), "ended", ref=c("launch")),
        fact(denials(events).select("*", blank.alias("q")), "denial", op=c("kind")),
        fact(question_denials(results), "question_denial", 1, ref=c("tool_use_id"), op=c("outcome")),
        fact(api_errors(events), "api_error"),
        fact(assistant_texts(events), "assistant", text=c("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("us", F.unix_micros(F.try_to_timestamp("ts")))


