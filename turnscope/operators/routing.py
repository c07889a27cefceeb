"""From fires to what a turn would show: actions, budget, rendering, verdict capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.plans.ordered import flag, scan
from turnscope.sources import catalogue as C

PLACE = ["ts", "seq", "rule", "key"]


def with_actions(fires: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach each rule's runtime action and template. The catalogue is a few rows per rule."""
    acted = catalogue.select("rule", C.action().alias("action"), "template")
    return fires.join(acted, "rule", "left").withColumn(
        "action", F.coalesce("action", F.lit("skip"))
    )


def fire_routing(
    fires: DataFrame, catalogue: DataFrame, phase: int = 3, budget: int | None = None
) -> DataFrame:
    """Decide each fire: surfaced, deduped, or suppressed and why.

    A cause counts once per session. Asks are budgeted by a running count of first occurrences
    that have something to say.
    """
    budget = C.ask_budget() if budget is None else budget
    acted = with_actions(fires, catalogue)
    silent = F.col("action").isin("augment", "skip")
    firsts = (
        acted.where(~silent).groupBy("sid", "rule", "key")
        .agg(F.min("idx").alias("idx"))
        .withColumn("_first", F.lit(True))
    )
    rows = acted.where(~silent).join(firsts, ["sid", "rule", "key", "idx"], "left")
    first = F.coalesce("_first", F.lit(False)) & ~silent
    can_ask = first & (F.col("action") != "log") & F.lit(phase >= 3)
    eligible = can_ask & F.col("template").isNotNull()
    # silent fires are most of all; they neither ask nor count, so they take no part in the order
    quiet = acted.where(silent).select("*", F.lit(None).cast("boolean").alias("_first"), F.lit(0).cast("long").alias("_asked"))
    counted = scan(rows, ["sid"], PLACE, sums={"_asked": flag(eligible)}).unionByName(quiet)
    suppressed = (
        F.when(F.col("action") == "skip", "not-in-catalogue")
        .when(F.col("action") == "augment", None)
        .when(~first, None)
        .when(F.col("action") == "log", "precision-floor")
        .when(F.lit(phase < 3), "phase-2")
        .when(F.col("_asked") >= budget, "ask-budget")
        .when(F.col("template").isNull(), "no-template")
    )
    deduped = ~silent & ~first
    told = F.when(F.col("action") == "augment", F.col("template").isNotNull()).otherwise(
        eligible & (F.col("_asked") < budget)
    )
    return counted.select(
        "sid", "ts", "seq", "us", "chunk", "idx", "rule", "key", "why", "detail", "action", "template",
        told.alias("surfaced"), deduped.alias("deduped"), suppressed.alias("suppressed"),
        (told & (F.col("action") != "augment")).alias("pending_verdict"),
    )


def render(template: str, cwd: str) -> F.Column:
    """Substitute the place, then the reason, then the detail (which may itself hold braces)."""
    text = F.replace(F.col(template), F.lit("{cwd}"), F.lit(cwd))
    text = F.replace(text, F.lit("{why}"), F.coalesce("why", F.lit("")))
    return F.replace(text, F.lit("{detail}"), F.coalesce("detail", F.lit("")))


def render_injections(routed: DataFrame, cwd: str = ".") -> DataFrame:
    return routed.where("surfaced").withColumn("text", render("template", cwd))


def turn_bundle(routed: DataFrame, cwd: str = ".") -> DataFrame:
    """Per message with anything to show: the joined text, surfaced rules, asked rules.

    A turn holds at most one silent fire per rule plus the session's ask budget.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rule", "key", "text")))
    asked = F.collect_set(F.when(F.col("pending_verdict"), F.col("rule")))
    return render_injections(routed, cwd).groupBy("sid", "idx").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("context"),
        F.array_join(F.array_sort(F.collect_set("rule")), " ").alias("fired"),
        F.array_join(F.array_sort(asked), " ").alias("asked"),
    )


def fire_log(routed: DataFrame, log: DataFrame, phase: int = 3) -> DataFrame:
    """Every fire, shown or not, as the append-only log keeps it."""
    timing = log.where("kind = 'message'").select("sid", "seq", "elapsed_ms")
    return routed.join(timing, ["sid", "seq"]).select(
        "ts", "sid", "idx", "rule", "key", "action", "surfaced", F.lit(phase).alias("phase"),
        "why", F.substring("detail", 1, 300).alias("detail"), "deduped", "suppressed",
        "pending_verdict", "elapsed_ms",
    )


def reply_verdicts(msgs: DataFrame) -> DataFrame:
    return msgs.select("sid", "idx", X.reply_verdict("text").alias("verdict"))


def pending_resolution(routed: DataFrame, msgs: DataFrame) -> DataFrame:
    """Asks of one turn are judged on the next message only; several at once cannot be attributed."""
    asks = routed.where("pending_verdict").select("sid", F.col("idx").alias("asked_idx"), "rule", "key", "action")
    per_turn = asks.groupBy("sid", "asked_idx").agg(F.count("*").alias("n"))
    replies = msgs.select("sid", (F.col("idx") - 1).alias("asked_idx"), "text")
    alone = F.col("n") == 1
    return (
        asks.join(per_turn, ["sid", "asked_idx"]).join(replies, ["sid", "asked_idx"])
        .select(
            "sid", "asked_idx", "rule", "key", "action",
            F.when(alone, X.reply_verdict("text")).otherwise("unlabelled").alias("verdict"),
            F.when(alone, F.substring(X.squash("text"), 1, 200)).otherwise(
                F.concat(F.col("n").cast("string"), F.lit(" fires pending; reply cannot be attributed"))
            ).alias("note"),
        )
    )
