"""Signal coverage: which messages show trouble, and did a rule notice?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V


def signal_matches(msgs: DataFrame) -> DataFrame:
    """One row per (message, matching signal family)."""
    hits = F.array(*[
        F.when(F.col("text").rlike(p), F.lit(name)) for name, p in V.SIGNALS
    ])
    return msgs.select(
        "sid", "ts", "seq", "idx", "text", F.explode(F.array_compact(hits)).alias("signal")
    )


def rules_per_message(fires: DataFrame) -> DataFrame:
    """Distinct rules per message, leaving out those that always fire; at most one entry a rule."""
    return (
        fires.where(~F.col("rule").isin(*V.ALWAYS)).groupBy("sid", "idx")
        .agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    )


def matched_rules(msgs: DataFrame, fires: DataFrame) -> DataFrame:
    blind = F.array(*[F.lit(r) for r in V.CONTENT_BLIND])
    none = F.array().cast("array<string>")
    return (
        signal_matches(msgs).join(rules_per_message(fires), ["sid", "idx"], "left")
        .withColumn("rules", F.coalesce("rules", none))
        .withColumn("real", F.size(F.array_except("rules", blind)) > 0)
    )


def coverage_table(msgs: DataFrame, fires: DataFrame) -> DataFrame:
    counts = matched_rules(msgs, fires).groupBy("signal").agg(
        F.count("*").alias("messages"),
        F.count_if("real").alias("real"),
        F.count_if(~F.col("real") & (F.size("rules") > 0)).alias("blind_only"),
        F.count_if(~F.col("real") & (F.size("rules") == 0)).alias("none"),
    )
    names = F.explode(F.array(*[F.lit(n) for n, _ in V.SIGNALS])).alias("signal")
    every = msgs.sparkSession.range(1).select(names)
    zero = F.lit(0).cast("long")
    cols = ("messages", "real", "blind_only", "none")
    return (
        every.join(counts, "signal", "left")
        .select("signal", *[F.coalesce(c, zero).alias(c) for c in cols])
        .withColumn("coverage", F.try_divide("real", "messages"))
    )


def coverage_by_rule(msgs: DataFrame, fires: DataFrame) -> DataFrame:
    return (
        matched_rules(msgs, fires).select("signal", F.explode("rules").alias("rule"))
        .groupBy("signal", "rule").agg(F.count("*").alias("messages"))
    )


def uncovered_samples(msgs: DataFrame, fires: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` messages per family that no informative rule noticed."""
    w = Window.partitionBy("signal").orderBy("sid", "idx")
    missed = matched_rules(msgs, fires).where("NOT real")
    return (
        missed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
        .select("signal", "n", X.message_id("sid", "idx").alias("message"),
                F.array_join("rules", " ").alias("blind"), X.strip(X.squash("text")).alias("text"))
    )
