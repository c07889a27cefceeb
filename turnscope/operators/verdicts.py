"""External judgements kept as append-only tables; the last write per key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.operators import state
from turnscope.plans.ordered import scan
from turnscope.session import materialize


def latest(writes: DataFrame) -> DataFrame:
    """Last row per key. An aggregate, so rewrites of a hot key combine before the shuffle."""
    rest = [c for c in writes.columns if c != "key"]
    return (
        writes.where("key IS NOT NULL").groupBy("key")
        .agg(F.max_by(F.struct(*rest), "ord").alias("v")).select("key", "v.*")
    )


def markers(writes: DataFrame, kind: str | None = None) -> DataFrame:
    """Keys whose last verdict says desync. Filtering comes after last-write-wins, never before."""
    out = latest(writes).where("desync")
    return out.where(F.col("kind") == kind) if kind else out


def marked_keys(writes: DataFrame) -> DataFrame:
    """The keys of ``markers`` alone: one flag per key is carried, not the whole verdict."""
    last = writes.where("key IS NOT NULL").groupBy("key").agg(F.max_by("desync", "ord").alias("desync"))
    return last.where("desync").select("key")


def any_signal(c: str) -> Column:
    hit = F.lit(False)
    for _, pattern in V.SIGNALS:
        hit = hit | F.col(c).rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def judged(writes: DataFrame) -> DataFrame:
    return latest(writes).select(
        "*", F.coalesce("desync", F.lit(False)).alias("verdict"), any_signal("text").alias("regex")
    )


def verdict_agreement(writes: DataFrame) -> DataFrame:
    """Confusion counts of verdict against wording, with each cell's share and the agreement."""
    rows = judged(writes)
    total = rows.agg(F.count("*")).scalar()
    same = rows.agg(F.count_if(F.col("verdict") == F.col("regex"))).scalar()
    cells = rows.groupBy("verdict", "regex").agg(F.count("*").alias("n"))
    return cells.select("verdict", "regex", "n", (100.0 * same / total).alias("agreement_pct"))


def verdict_disagreements(writes: DataFrame, limit: int = 12) -> DataFrame:
    rows = judged(writes).where("verdict <> regex").orderBy("ord", "key").limit(limit)
    return rows.select(
        F.when(F.col("verdict"), "regex missed").otherwise("regex false positive").alias("case"),
        "key", "kind", "confidence", F.substring("text", 1, 74).alias("text"),
    )


def desync_kind_counts(writes: DataFrame) -> DataFrame:
    return latest(writes).groupBy("desync", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "desync", "kind")


def directive_strength(writes: DataFrame) -> DataFrame:
    """Counts by strength and by confidence, in one table."""
    rows = latest(writes)
    split = rows.select(F.expr("stack(2, 'strength', strength, 'confidence', confidence) AS (field, value)"))
    return split.groupBy("field", "value").agg(F.count("*").alias("n"))


def directive_forms(writes: DataFrame) -> DataFrame:
    """How often each form is flagged; forms overlap."""
    counts = latest(writes).agg(*[F.count_if(f).alias(f) for f in V.FORMS])
    return counts.unpivot([], list(V.FORMS), "form", "n")


def form_names() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in V.FORMS]))


def directive_combos(writes: DataFrame) -> DataFrame:
    weakened = latest(writes).where("strength = 'weakened'")
    combo = F.array_join(form_names(), "+")
    return weakened.groupBy(
        F.when(combo == "", "(none flagged)").otherwise(combo).alias("forms")
    ).agg(F.count("*").alias("n"))


def squashed(c: str) -> Column:
    return X.squash(F.coalesce(c, F.lit("")))


def desync_contract(writes: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows that break the judge's rules, with the rules broken.

    ``previous``: key, previous — the assistant turn each judged message answers.
    """
    rows = writes.join(previous, "key", "left")
    quote, contradicts = F.coalesce("quote", F.lit("")), F.coalesce("contradicts", F.lit(""))
    broken = F.array_compact(F.array(
        F.when(~F.col("kind").isin(*V.DESYNC_KINDS) | ~F.col("confidence").isin(*V.CONFIDENCE), "bad-enum"),
        F.when(~F.col("desync") & (F.col("kind") != "none"), "kind-without-desync"),
        F.when((F.col("confidence") == "high") & (contradicts == ""), "high-without-contradicts"),
        F.when((quote != "") & ~F.contains(F.col("text"), quote), "quote-not-verbatim"),
        F.when(
            (contradicts != "") & ~F.contains(F.coalesce("previous", F.lit("")), contradicts),
            "contradicts-not-verbatim",
        ),
    ))
    return rows.select("key", "ord", F.array_join(broken, ",").alias("broken")).where("broken <> ''")


def directive_contract(writes: DataFrame) -> DataFrame:
    flagged = F.lit(False)
    for f in V.FORMS:
        flagged = flagged | F.col(f)
    broken = F.array_compact(F.array(
        F.when(~F.col("strength").isin(*V.STRENGTHS) | ~F.col("confidence").isin(*V.CONFIDENCE), "bad-enum"),
        F.when(flagged & (F.col("strength") != "weakened"), "flag-without-weakened"),
    ))
    return writes.select("key", "ord", F.array_join(broken, ",").alias("broken")).where("broken <> ''")


def previous_turns(log: DataFrame) -> DataFrame:
    """Per human message: the latest non-blank assistant text before it, '' if none."""
    spoke = state.is_kind("launch", "assistant") & (X.strip(F.coalesce("text", F.lit(""))) != "")
    rows = scan(
        log, ["sid"], state.ORDER,
        sums={"_before": F.when(state.is_kind("message"), 1).otherwise(0)},
        lasts={"_prev": F.when(spoke, F.col("text"))},
    ).where(state.is_kind("message"))
    return rows.select(
        "sid", "ts", "seq", (F.col("_before") + 1).alias("idx"), "text",
        X.message_key("sid", "text").alias("key"),
        F.coalesce("_prev", F.lit("")).alias("previous"),
    )


def judgement_requests(turns: DataFrame) -> DataFrame:
    """What an external labeller is shown, cut only where a limit is set."""
    n = V.REQUEST_MAX_CHARS
    return turns.select(
        "key", "sid", "idx",
        F.coalesce(
            F.nullif(X.cut("previous", n), F.lit("")), F.lit(V.FIRST_MESSAGE_PLACEHOLDER)
        ).alias("previous"),
        X.cut("text", n).alias("message"),
    )


def uncached_requests(turns: DataFrame, writes: DataFrame, recheck: bool = False) -> DataFrame:
    requests = judgement_requests(turns)
    return requests if recheck else requests.join(writes.select("key"), "key", "left_anti")


def global_rank(msgs: DataFrame) -> DataFrame:
    """0-based position over all sessions in (sid, idx) order.

    Rows are sorted by ranges and written; each range's rows are numbered as they lie, and what earlier ranges hold is
    added from one count per range. Ranges are cut from the keys that occur, so neither a session nor ids of one
    shared prefix gather in a task.
    """
    lying = F.monotonically_increasing_id()  # range number in the upper bits, place within it in the lower 33
    ranged = materialize(msgs.repartitionByRange("sid", "idx").sortWithinPartitions("sid", "idx").withColumn("_at", lying), "ranges")
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = ranged.withColumn("_range", F.shiftright("_at", 33))
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("n"))  # as many rows as there were tasks
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(starts, "_range").withColumn("pos", F.col("_start") + place).drop("_at", "_range", "_start")


def systematic_sample(msgs: DataFrame, limit: int = 100) -> DataFrame:
    """Every step-th message in order, the first ``limit``; step = max(1, n div limit)."""
    step = F.greatest(F.lit(1), F.floor(msgs.agg(F.count("*")).scalar() / limit))
    ranked = global_rank(msgs)
    return ranked.where((F.col("pos") % step == 0) & (F.col("pos") < step * limit))
