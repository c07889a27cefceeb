"""Looking back from markers and ahead from directives.

Neighbouring messages meet through equi joins on (session, ordinal), so no window spans a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.operators import rules, similar, state, verdicts


def active_rules(inputs: rules.Inputs, only=tuple(rules.RULES)) -> DataFrame:
    """(sid, idx, rule) for every message at which a rule holds, causes that persist included."""
    persistent = ("R01", "R04", "R12")
    direct = [r for r in only if r not in persistent and r not in V.ALWAYS]
    out = rules.evaluate(inputs, direct).select("sid", "idx", "rule").distinct()
    msgs = inputs.messages.select("sid", "idx", "ts", "seq", "chunk")
    runs = {"R01": draft_runs, "R04": lambda i: state.open_questions(i.log), "R12": delivery_runs}
    for rule in persistent:
        if rule in only:
            held = state.counts_over(msgs, runs[rule](inputs), "n").where("n > 0")
            out = out.unionByName(held.select("sid", "idx", F.lit(rule).alias("rule")))
    return out


def until_hidden(causes: DataFrame, inputs: rules.Inputs) -> DataFrame:
    """Where memory is limited, end a cause's run when its queue operation is forgotten."""
    if V.MAX_QUEUE_OPS is None:
        return state.clip_runs(causes)
    marks = inputs.marked
    hiding = marks.where("kind = 'queue'").select(
        "sid", (F.col("ops_before") - V.MAX_QUEUE_OPS).alias("ops_before"),
        (F.col("messages_before") + 1).alias("_hidden"),
    )
    ended = causes.join(hiding, ["sid", "ops_before"], "left")
    return state.clip_runs(ended.withColumn("end_idx", F.least("end_idx", "_hidden")))


def delivery_runs(inputs: rules.Inputs) -> DataFrame:
    fires = rules.rule_r12(inputs).select("sid", F.col("idx").alias("first_idx"), "key")
    stamp = F.concat(F.lit("lost:"), rules.iso_offset("us"))
    ops = (
        inputs.marked.where("kind = 'queue' AND op = 'dequeue' AND us IS NOT NULL")
        .groupBy("sid", stamp.alias("key"))
        .agg(F.max("ops_before").alias("ops_before"), F.max("n_messages").alias("n_messages"))
    )
    causes = fires.join(ops, ["sid", "key"]).withColumn("end_idx", F.lit(None).cast("long"))
    return until_hidden(causes, inputs).select("sid", "first_idx", "last_idx")


def draft_runs(inputs: rules.Inputs) -> DataFrame:
    """A withdrawn draft stays unresolved until the first message resembling it."""
    threshold = inputs.param("R01", "similarity")
    lost = rules.unresolved_retractions(inputs)
    found = similar.with_resemblance(lost, rules.sent_texts(inputs), threshold, early_only=False, enough=1)
    causes = found.withColumn("first_idx", F.col("upto")).withColumnRenamed("hit_idx", "end_idx")
    return until_hidden(causes, inputs).select("sid", "first_idx", "last_idx")


def located_markers(msgs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each marker with the first message carrying its key; idx NULL when none does."""
    keyed = msgs.select("sid", "idx", X.message_key("sid", "text").alias("key"))
    place = keyed.groupBy("key").agg(F.min("idx").alias("idx"), F.first("sid").alias("_sid"))
    return marks.select("key", "sid", "kind", "confidence").join(place, "key", "left").drop("_sid")


def marker_location(msgs: DataFrame, marks: DataFrame) -> DataFrame:
    return located_markers(msgs, marks).agg(
        F.count("*").alias("markers"), F.count("idx").alias("located"),
        F.count_if(F.col("idx").isNull()).alias("unmatched"),
    )


def window_before(msgs: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """(marker key, back, message) for the k messages before each located marker."""
    spots = located_markers(msgs, marks).where("idx IS NOT NULL").select(
        "key", "sid", "kind", F.col("idx").alias("at_idx"),
        F.explode(F.sequence(F.lit(1), F.lit(k))).alias("back"),
    )
    return spots.withColumn("idx", F.col("at_idx") - F.col("back")).where("idx >= 1")


def lookback_trace(msgs: DataFrame, marks: DataFrame, active: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    fired = active.groupBy("sid", "idx").agg(F.array_join(F.array_sort(F.collect_set("rule")), " ").alias("fired"))
    held = facts.groupBy("sid", "idx").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("fact", F.lit(" x"), F.col("n").cast("string")))), ", ").alias("facts")
    )
    blank = F.lit("")
    return (
        window_before(msgs, marks, k)
        .join(fired, ["sid", "idx"], "left").join(held, ["sid", "idx"], "left")
        .select("key", "sid", "at_idx", "back", "idx",
                F.coalesce("fired", blank).alias("fired"), F.coalesce("facts", blank).alias("facts"))
    )


def rules_before_markers(msgs: DataFrame, marks: DataFrame, active: DataFrame, k: int = 3) -> DataFrame:
    return (
        window_before(msgs, marks, k).join(active, ["sid", "idx"])
        .groupBy("rule").agg(F.count("*").alias("n"))
        .withColumn("content_blind", F.col("rule").isin(*V.CONTENT_BLIND))
    )


def facts_before_markers(msgs: DataFrame, marks: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    return (
        window_before(msgs, marks, k).join(facts.select("sid", "idx", "fact"), ["sid", "idx"])
        .groupBy("fact").agg(F.count("*").alias("n"))
    )


def silent_markers(msgs: DataFrame, marks: DataFrame, active: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    """Located markers with neither an informative rule nor a fact in the window before."""
    real = active.where(~F.col("rule").isin(*V.CONTENT_BLIND)).select("sid", "idx")
    spoken = window_before(msgs, marks, k).join(
        real.unionByName(facts.select("sid", "idx")).distinct(), ["sid", "idx"], "left_semi"
    ).select("key").distinct()
    return (
        located_markers(msgs, marks).where("idx IS NOT NULL")
        .join(spoken, "key", "left_anti").select("key", "sid", "idx", "kind")
    )


def fact_lift(msgs: DataFrame, marks: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    """Share of messages before a marker with the fact, over the share of all messages."""
    before = window_before(msgs, marks, k)
    near = before.join(facts.select("sid", "idx", "fact"), ["sid", "idx"]).groupBy("fact").agg(F.count("*").alias("before_hits"))
    base = facts.groupBy("fact").agg(F.count("*").alias("base_hits"))
    n_before, n_all = before.agg(F.count("*")).scalar(), msgs.agg(F.count("*")).scalar()
    shares = base.join(near, "fact", "left").select(
        "fact",
        F.try_divide(F.coalesce("before_hits", F.lit(0)), n_before).alias("before_share"),
        F.try_divide("base_hits", n_all).alias("base_share"),
    )
    return shares.withColumn("lift", F.try_divide("before_share", "base_share"))


def directives_followed(msgs: DataFrame, directives: DataFrame, desyncs: DataFrame, k: int) -> DataFrame:
    """Directive messages with the distance to the next marker, if one lands in the next k messages."""
    keyed = msgs.select("sid", "idx", X.message_key("sid", "text").alias("key"))
    hit = keyed.join(verdicts.markers(desyncs).select("key"), "key", "left_semi")
    reach = (
        hit.select("sid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("d"), "idx")
        .groupBy("sid", (F.col("idx") - F.col("d")).alias("idx")).agg(F.min("d").alias("ahead"))
    )
    judged = verdicts.latest(directives).where("is_directive AND strength IN ('direct', 'weakened')")
    return (
        keyed.join(judged.drop("sid"), "key").join(reach, ["sid", "idx"], "left")
        .withColumn("followed", F.col("ahead").isNotNull())
    )


def lookahead_rates(msgs: DataFrame, directives: DataFrame, desyncs: DataFrame, windows=(1, 2, 3)) -> DataFrame:
    """Per window and strength: directives, those followed by a marker, and their share. One pass for all windows."""
    rows = directives_followed(msgs, directives, desyncs, max(windows))
    hits = F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("ahead") <= k).alias("hits")) for k in windows])
    counted = rows.groupBy("strength").agg(F.count("*").alias("total"), hits.alias("per_window"))
    return counted.select("strength", "total", F.inline("per_window")).select(
        "k", "strength", "total", "hits", F.try_divide("hits", "total").alias("rate"))


def relative_risk(msgs: DataFrame, directives: DataFrame, desyncs: DataFrame, windows=(1, 2, 3)) -> DataFrame:
    rates = lookahead_rates(msgs, directives, desyncs, windows)
    sides = rates.groupBy("k").agg(
        F.max(F.when(F.col("strength") == "direct", F.col("rate"))).alias("direct_rate"),
        F.max(F.when(F.col("strength") == "weakened", F.col("rate"))).alias("weakened_rate"),
    )
    return sides.withColumn("relative_risk", F.try_divide("weakened_rate", "direct_rate"))


def by_form(rows: DataFrame) -> DataFrame:
    names = verdicts.form_names()
    fallback = F.array(F.lit("(unflagged)"))
    return rows.where("strength = 'weakened'").withColumn(
        "form", F.explode(F.when(F.size(names) > 0, names).otherwise(fallback))
    )


def form_rates(msgs: DataFrame, directives: DataFrame, desyncs: DataFrame, k: int = 3) -> DataFrame:
    rows = directives_followed(msgs, directives, desyncs, k)
    base = rows.where("strength = 'direct'").agg(
        F.try_divide(F.count_if("followed"), F.count("*"))
    ).scalar()
    counted = by_form(rows).groupBy("form").agg(
        F.count("*").alias("total"), F.count_if("followed").alias("hits")
    )
    return counted.select(
        "form", "total", "hits", F.try_divide("hits", "total").alias("rate"),
        F.try_divide(F.try_divide("hits", "total"), base).alias("vs_direct"),
    )


def form_examples(msgs: DataFrame, directives: DataFrame, desyncs: DataFrame, k: int = 3, n: int = 4) -> DataFrame:
    w = Window.partitionBy("form").orderBy("sid", "idx")
    rows = by_form(directives_followed(msgs, directives, desyncs, k)).where("followed")
    return (
        rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
        .select("form", "n", X.message_id("sid", "idx").alias("message"), F.substring("text", 1, 84).alias("text"))
    )
