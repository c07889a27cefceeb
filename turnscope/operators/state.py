"""What was known before each message was sent.

Every column here comes from an ordered scan that ends before the row, so no later fact can leak
in. Facts that hold over a run of messages (an open question, a task still running) are kept as one
row per run, ``first_idx .. last_idx`` in message ordinals: the per-message list is quadratic in
the session, the runs are linear and lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.plans.ordered import flag, scan

ORDER = ["ts", "seq"]


def is_kind(*kinds: str):
    return F.col("kind").isin(*kinds)


def human_queue_op():
    """Queue content typed by a person: non-empty and not machine-written."""
    return is_kind("queue") & (F.length("text") > 0) & ~X.is_system_text("text")


MARKS = ("messages_before", "ops_before", "messages_upto", "n_messages")


def is_marked(log: DataFrame) -> bool:
    return set(MARKS) <= set(log.columns)


def messages(log: DataFrame) -> DataFrame:
    """Human messages with ordinal ``idx`` (from 1) within the session."""
    rows = log.where(is_kind("message"))
    if not is_marked(log):
        rows = scan(
            rows.select("sid", "ts", "seq", "us", "chunk", "text"), ["sid"], ORDER,
            sums={"messages_before": F.lit(1)},
        )
    return rows.select("sid", "ts", "seq", "us", "chunk", F.expr("messages_before + 1 AS idx"), "text")


def marked(log: DataFrame) -> DataFrame:
    """The fact stream with each fact's place among the session's messages and queue operations.

    A log that already carries the marks is returned as it is, so a marked log written once
    serves every rule without another scan.
    """
    if is_marked(log):
        return log
    said = flag(is_kind("message"))
    return scan(
        log, ["sid"], ORDER,
        sums={"messages_before": said, "ops_before": flag(is_kind("queue"))},
        peers={"messages_upto": said},
        totals={"n_messages": said},
    )


def presend_counts(log: DataFrame) -> DataFrame:
    """Per message: how many messages, queue operations, launches, errors, denials preceded it."""
    counted = scan(
        log, ["sid"], ORDER,
        sums={
            "prior_messages": flag(is_kind("message")),
            "_ops": flag(is_kind("queue")),
            "launches": flag(is_kind("launch")),
            "api_errors": flag(is_kind("api_error")),
            "denials": flag(is_kind("denial")),
        },
    ).where(is_kind("message"))
    return counted.select(
        "sid", (F.col("prior_messages") + 1).alias("idx"), "prior_messages",
        (F.least("_ops", F.lit(V.MAX_QUEUE_OPS)) if V.MAX_QUEUE_OPS else F.col("_ops")).alias("queue_ops"),
        "launches", "api_errors", "denials",
    )


def clip_runs(runs: DataFrame) -> DataFrame:
    """Bound each run by the session's messages and drop empty ones."""
    last = F.least("n_messages", F.coalesce(F.col("end_idx") - 1, F.col("n_messages")))
    return runs.withColumn("last_idx", last).where("first_idx <= last_idx")


def task_runs(marks: DataFrame, enders: tuple[str, ...], strict_time: bool) -> DataFrame:
    """Runs of messages during which a launched task had not ended by any of ``enders``."""
    begins = (
        F.when(F.col("ts") == "", F.col("messages_before")).otherwise(F.col("messages_upto"))
        if strict_time
        else F.col("messages_before")
    )
    launches = marks.where(is_kind("launch") & F.col("ref").isNotNull()).select(
        "sid", F.col("ref").alias("task"), (begins + 1).alias("first_idx"), "n_messages"
    )
    ends = (
        marks.where(is_kind(*enders) & F.col("ref").isNotNull())
        .groupBy("sid", F.col("ref").alias("task"))
        .agg((F.min("messages_before") + 1).alias("end_idx"))
    )
    return clip_runs(launches.join(ends, ["sid", "task"], "left")).select(
        "sid", "task", "first_idx", "last_idx"
    )


def stale_tasks(log: DataFrame) -> DataFrame:
    """Tasks launched strictly earlier and neither notified nor ended, as runs of messages."""
    return task_runs(marked(log), ("notified", "ended"), strict_time=True)


def unreported_tasks(log: DataFrame) -> DataFrame:
    """Tasks never notified; endings and times are ignored, as the look-back fact does."""
    return task_runs(marked(log), ("notified",), strict_time=False)


def question_versions(log: DataFrame) -> DataFrame:
    """Each question's outcome as runs of messages: answered until denied, last denial wins."""
    marks = marked(log)
    asked = marks.where(is_kind("question")).select(
        "sid", F.col("ref").alias("question"), F.struct(*ORDER).alias("asked_at"),
        "ts", "seq", "chunk", "messages_before", "n_messages", F.lit("answered").alias("outcome"),
    )
    denied = marks.where(is_kind("denial", "question_denial") & F.col("ref").isNotNull()).select(
        "sid", F.col("ref").alias("question"), "ts", "seq", "chunk", "messages_before", "n_messages",
        F.col("op").alias("outcome"),
    )
    # a denial counts only for a question already asked
    known = denied.join(asked.select("sid", "question", "asked_at"), ["sid", "question"]).where(
        F.struct(*ORDER) > F.col("asked_at")
    )
    place = F.struct(*ORDER)
    versions = (
        asked.drop("asked_at").unionByName(known.drop("asked_at"))
        .groupBy("sid", "question", "messages_before")
        .agg(
            F.max_by("outcome", place).alias("outcome"),
            F.max_by("chunk", place).alias("chunk"),
            F.max(place).alias("_place"),
            F.max("n_messages").alias("n_messages"),
        )
        .select("*", "_place.ts", "_place.seq")
        .withColumn("first_idx", F.col("messages_before") + 1)
    )
    runs = scan(versions, ["sid", "question"], ORDER, nexts={"end_idx": F.col("first_idx")})
    return clip_runs(runs).select("sid", "question", "outcome", "first_idx", "last_idx")


def open_questions(log: DataFrame) -> DataFrame:
    return question_versions(log).where("outcome <> 'answered'")


def counts_over(msgs: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    """Number of runs covering each message, by a running sum of +1 / -1 steps."""
    steps = (
        runs.select("sid", F.explode(F.array(
            F.struct(F.col("first_idx").alias("idx"), F.lit(1).cast("long").alias("step")),
            F.struct((F.col("last_idx") + 1).alias("idx"), F.lit(-1).cast("long").alias("step")),
        )).alias("s"))
        .groupBy("sid", F.col("s.idx").alias("idx"))
        .agg(F.sum("s.step").alias("_step"))
    )
    stepped = msgs.join(steps, ["sid", "idx"], "left")
    own = F.coalesce(F.col("_step"), F.lit(0).cast("long"))
    return (
        scan(stepped, ["sid"], ORDER, sums={"_run": own})
        .withColumn(name, F.col("_run") + own)
        .drop("_run", "_step")
    )


def visible_removes(log: DataFrame, max_ops: int | None = V.MAX_QUEUE_OPS) -> DataFrame:
    """Per message: human removals, with a limit only those among the newest ``max_ops`` queue operations."""
    removed = human_queue_op() & (F.col("op") == "remove")
    counted = scan(
        log, ["sid"], ORDER,
        sums={
            "_msgs": flag(is_kind("message")),
            "_ops": flag(is_kind("queue")),
            "_removed": flag(removed),
        },
    )
    if max_ops is None:
        return counted.where(is_kind("message")).select(
            "sid", (F.col("_msgs") + 1).alias("idx"), F.col("_removed").alias("n"))
    forgotten = counted.where(is_kind("queue")).select(
        "sid", (F.col("_ops") + 1 + max_ops).alias("_ops"),
        (F.col("_removed") + flag(removed)).alias("_forgotten"),
    )
    return (
        counted.where(is_kind("message"))
        .join(forgotten, ["sid", "_ops"], "left")
        .select(
            "sid", (F.col("_msgs") + 1).alias("idx"),
            (F.col("_removed") - F.coalesce("_forgotten", F.lit(0))).alias("n"),
        )
    )


def state_facts(log: DataFrame) -> DataFrame:
    """Named facts that hold at each message, with counts: (sid, idx, fact, n), n > 0."""
    msgs = messages(log).select("sid", "idx", "ts", "seq", "chunk")
    opened = counts_over(msgs, open_questions(log), "n").select(
        "sid", "idx", F.lit("open-question").alias("fact"), "n")
    tasks = counts_over(msgs, unreported_tasks(log), "n").select(
        "sid", "idx", F.lit("unreported-task").alias("fact"), "n")
    removes = visible_removes(log).select("sid", "idx", F.lit("queue-remove").alias("fact"), "n")
    plain = presend_counts(log).select(
        "sid", "idx",
        F.expr("stack(2, 'api-error', api_errors, 'denial', denials) as (fact, n)"),
    )
    return opened.unionByName(tasks).unionByName(removes).unionByName(plain).where("n > 0")
