"""Summaries of the operational logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.operators import labels
from turnscope.session import materialize


def fires_summary(log: DataFrame) -> DataFrame:
    """Counts per rule and the grand total (rule NULL), from one pass."""
    return log.rollup("rule").agg(
        F.count("*").alias("fires"), F.count_if("surfaced").alias("surfaced"), F.count_if("deduped").alias("deduped"),
    )


def suppression_counts(log: DataFrame) -> DataFrame:
    return log.where("suppressed IS NOT NULL").groupBy("suppressed").agg(F.count("*").alias("n"))


def bands(values: DataFrame) -> DataFrame:
    """Exact order statistics per ``band``: upper median, element int(0.95 n), maximum. ``values``: band, value
    (NULL and NaN ignored).

    Selection by rounds: every round narrows the interval in which a wanted rank lies, by a histogram of it, until the
    interval holds one value: about log(n) / log(64) rounds. A round is one sketch and one pre-aggregated count per
    (band, wanted rank, cell), so nothing is sorted or ranked in one task, whatever the values and however many bands.
    """
    number = F.col("value").cast("double")
    known = materialize(values.select("band", number.alias("value")).where("value IS NOT NULL AND NOT isnan(value)"), "values")
    totals = known.groupBy("band").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    ranks = F.explode(F.array(
        F.struct(F.lit("median").alias("name"), F.floor(F.col("n") / 2).alias("rank")),
        F.struct(F.lit("p95").alias("name"), F.floor(F.col("n") * F.lit(0.95)).alias("rank"))))
    wanted = totals.select("band", "n", F.col("high").alias("max"), "low", "high", ranks.alias("w")).select(
        "band", "n", "max", "low", "high", "w.name", "w.rank")
    while True:
        wanted = materialize(wanted, "wanted")
        if wanted.where("low < high").isEmpty():
            break
        wanted = narrowed(known, wanted)
    return wanted.groupBy("band").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("name") == "median", F.col("low"))).alias("median"),
        F.max(F.when(F.col("name") == "p95", F.col("low"))).alias("p95"), F.max("max").alias("max"))


CUTS = 64


def narrowed(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ranks with the least and greatest value of the cell of [low, high] in which each lies.

    ``rank`` counts from the first value of the interval. The cuts between cells come from a mergeable sketch of what
    the interval holds, so that a cell has about a ``CUTS``-th of it however the values are spread; a cut is a cell of
    its own, so values that repeat end the search. The counts are exact, whatever the sketch says.
    """
    open_ = wanted.where("low < high")
    inside = known.join(open_.select("band", "name", "low", "high"), "band").where("value BETWEEN low AND high")
    cuts = inside.groupBy("band", "name").agg(
        F.percentile_approx("value", [k / CUTS for k in range(CUTS + 1)], 1000).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    cell = 2 * below + F.array_contains("cuts", F.col("value")).cast("int")
    counts = inside.join(cuts, ["band", "name"]).groupBy("band", "name", cell.alias("cell")).agg(
        F.count("*").alias("c"), F.min("value").alias("cell_low"), F.max("value").alias("cell_high"))
    upto = Window.partitionBy("band", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # few cells
    placed = counts.withColumn("start", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    found = open_.drop("low", "high").join(placed, ["band", "name"]).where("rank >= start AND rank < start + c")
    return wanted.where("low >= high").unionByName(found.select(
        "band", "n", "max", F.col("cell_low").alias("low"), F.col("cell_high").alias("high"), "name",
        (F.col("rank") - F.col("start")).alias("rank")))


def latency_bands(log: DataFrame) -> DataFrame:
    return bands(log.select(F.lit("elapsed").alias("band"), F.col("elapsed_ms").alias("value")))


def normalise_status(rows: DataFrame) -> DataFrame:
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy("status").agg(F.count("*").alias("n")).select(
        "status", "n", (100.0 * F.col("n") / total).alias("pct")
    )


def normalise_bands(rows: DataFrame) -> DataFrame:
    """Bands for total, request and setup time; a zero total is left out, as is a missing part."""
    return bands(rows.select(F.expr(
        "stack(3, 'total', nullif(elapsed_ms, 0.0D), 'request', request_ms, 'setup', setup_ms) AS (band, value)"
    )))


def normalise_pairs(rows: DataFrame, limit: int = 20, restated_only: bool = True) -> DataFrame:
    """The newest before/after pairs."""
    kept = rows.where("status = 'restated'") if restated_only else rows
    return kept.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).select(
        "ts", "sid", "status", "elapsed_ms",
        F.substring(X.strip(X.squash("prompt")), 1, 300).alias("prompt"),
        F.substring(X.strip(X.squash("restatement")), 1, 300).alias("restatement"),
    )


def verdict_tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def recent_fires(
    log: DataFrame, label_rows: DataFrame, catalogue: DataFrame, limit: int = 20,
    rule: str | None = None, session_prefix: str | None = None, todo_only: bool = False,
) -> DataFrame:
    """Newest observation per cause, with its verdict and whether it still needs one."""
    rows = log
    if rule:
        rows = rows.where(F.col("rule") == rule)
    if session_prefix:
        rows = rows.where(F.startswith(F.col("sid"), F.lit(session_prefix)))
    newest = rows.groupBy("rule", "key").agg(
        F.max_by(
            F.struct("ts", "sid", "idx", "action", "surfaced", "deduped", "suppressed", "detail"),
            F.struct("ts", "sid", "idx"),
        ).alias("f")
    ).select("rule", "key", "f.*")
    verdicts = labels.labels_latest(label_rows).withColumnRenamed("fire_key", "key")
    judged = newest.join(verdicts, ["rule", "key"], "left").join(
        catalogue.select("rule", F.col("template").isNotNull().alias("_says")), "rule", "left"
    )
    todo = F.coalesce("_says", F.lit(False)) & F.col("verdict").isNull()
    out = judged.withColumn("todo", todo)
    if todo_only:
        out = out.where("todo")
    shown = F.when(F.col("verdict").isNull() & ~F.coalesce("_says", F.lit(False)), "n/a").otherwise(F.col("verdict"))
    return (
        out.orderBy(F.desc("ts"), F.desc("sid"), F.desc("rule"), F.desc("key")).limit(limit)
        .select("ts", "sid", "idx", "rule", "key", "action", shown.alias("verdict"), "todo", "surfaced", "deduped", "suppressed")
    )
