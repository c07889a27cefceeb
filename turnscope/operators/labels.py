"""Judging fires: hand verdicts first, then a per-rule strategy, else unknown (NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.operators import overlap, similar, state
from turnscope.plans.ordered import scan

VALID = ("applies", "does-not-apply")
STRATEGIES = ("R04", "R05", "R06", "R07", "R10", "R12")  # rules whose fires are judged without a hand


def labels_resolved(rows: DataFrame) -> DataFrame:
    """Last effective verdict per (rule, key); a synthetic row withdraws what came before it."""
    synthetic = F.coalesce("synthetic", F.lit(False))
    counts = (
        rows.where(synthetic | F.col("verdict").isin(*VALID))
        .where("rule IS NOT NULL AND fire_key IS NOT NULL")
        .groupBy("rule", "fire_key")
        .agg(F.max_by(F.struct("verdict", synthetic.alias("synthetic")), "ord").alias("v"))
    )
    return counts.where("NOT v.synthetic").select(
        "rule", "fire_key", (F.col("v.verdict") == "applies").alias("applies")
    )


def labels_latest(rows: DataFrame) -> DataFrame:
    """Last valid verdict per (rule, key), synthetic or not."""
    return (
        rows.where(F.col("verdict").isin(*VALID))
        .groupBy("rule", "fire_key")
        .agg(F.max_by("verdict", "ord").alias("verdict"))
    )


def correction_messages(msgs: DataFrame, markers: DataFrame) -> DataFrame:
    """Messages that correct something: the marked ones, or, while nothing at all is marked, those
    with correction wording."""
    keyed = msgs.withColumn("key", X.message_key("sid", "text"))
    marked = keyed.join(markers.select("key").distinct(), "key", "left_semi")
    any_marker = markers.agg(F.count("*").alias("n"))
    # the count is asked first: where anything is marked, no text is searched
    worded = keyed.where(any_marker.select("n").scalar() == 0).where(F.col("text").rlike(V.CORRECTION))
    return marked.unionByName(worded.select(*marked.columns)).drop("key")


def later_correction(fires: DataFrame, msgs: DataFrame, markers: DataFrame) -> DataFrame:
    """First strictly later correction that shares two vocabulary items with the fire's subject.

    Corrections keep only items that occur in some subject of their session.
    """
    asked = fires.where("us IS NOT NULL AND size(subject) >= 2").select(
        "sid", "ts", "seq", "us", "chunk", "idx", "rule", "key", "subject"
    )
    vocabulary = asked.select("sid", F.explode("subject").alias("tok")).distinct()
    spoken = (
        correction_messages(msgs, markers).where("us IS NOT NULL")
        .select("sid", "ts", "seq", "us", "chunk", "idx", F.explode(X.tokens("text")).alias("tok"))
        .join(vocabulary, ["sid", "tok"], "left_semi")
        .groupBy("sid", "ts", "seq", "us", "chunk", "idx")
        .agg(F.array_sort(F.collect_set("tok")).alias("items"))
    )
    wanted = asked.select(*overlap.PLACE, "rule", "key", F.array_sort(F.array_distinct("subject")).alias("items"))
    first = overlap.first_overlap(wanted, spoken)
    texts = msgs.select("sid", F.col("idx").alias("hit_idx"), F.col("text").alias("hit_text"))
    shared = F.array_intersect("subject", X.tokens("hit_text"))
    return (
        asked.join(first, ["sid", "idx", "rule", "key"])
        .join(texts, ["sid", "hit_idx"])
        .select(
            "sid", "idx", "rule", "key", "hit_idx",
            F.bround((F.col("hit_us") - F.col("us")) / 1e6, 0).cast("long").alias("gap_seconds"),
            F.array_join(F.slice(F.array_sort(shared), 1, 4), "/").alias("shared"),
            F.substring(X.squash("hit_text"), 1, 110).alias("quote"),
        )
    )


def label_r04(fires: DataFrame, msgs: DataFrame) -> DataFrame:
    """True when the session went on: three later messages, or one ten minutes later."""
    placed = scan(
        msgs, ["sid"], state.ORDER,
        peers={"_upto": F.lit(1)}, totals={"_n": F.lit(1)}, maxes={"_last": F.col("us")},
    )
    after = F.col("_n") - F.col("_upto")
    went_on = (after >= 3) | ((after > 0) & (F.col("_last") - F.col("us") >= 600_000_000))
    return fires.where("rule = 'R04'").select("sid", "idx", "rule", "key").join(
        placed.select("sid", "idx", F.coalesce(went_on, F.lit(False)).alias("auto_label")), ["sid", "idx"]
    ).select("sid", "idx", "rule", "key", "auto_label")


def label_r10(fires: DataFrame, msgs: DataFrame, threshold: float = 0.7, n_chars: int | None = None) -> DataFrame:
    """True when another message of the family, earlier or later, is much the same."""
    family = msgs.where(F.col("text").rlike(V.NO_CRITERION)).select(
        "sid", "idx", X.cut("text", n_chars).alias("b")
    )
    texts = family.groupBy("sid", "b").agg(F.count("*").alias("n"), F.lit(0).alias("first_idx"))
    probes = texts.select("sid", F.col("b").alias("a"), F.lit(0).alias("upto"), "n")
    # a text always resembles itself: a second hit, or a second message with it, is "another"
    found = similar.with_resemblance(probes, texts.drop("n"), threshold, enough=2)
    verdicts = found.select(
        "sid", F.col("a").alias("b"), ((F.col("n") > 1) | (F.col("hits") > 1)).alias("auto_label"))
    return (
        fires.where("rule = 'R10'").select("sid", "idx", "rule", "key")
        .join(family, ["sid", "idx"]).join(verdicts, ["sid", "b"])
        .select("sid", "idx", "rule", "key", "auto_label")
    )


def flag_labels(fires: DataFrame) -> DataFrame:
    """R07 holds only where a negation flipped; R12 always holds."""
    flipped = F.contains(F.col("detail"), F.lit("negation differs"))
    verdict = F.when(F.col("rule") == "R12", True).when(flipped, True)
    return fires.where("rule IN ('R07', 'R12')").select(
        "sid", "idx", "rule", "key", verdict.alias("auto_label")
    )


def basis_of(rule: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in V.BASIS.items() for v in kv])
    return F.coalesce(F.element_at(table, rule), F.lit("none"))


def labelled_fires(fires: DataFrame, msgs: DataFrame, markers: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Every fire with ``label`` TRUE / FALSE / NULL and whether a hand verdict decided it."""
    hindsight = later_correction(fires.where("rule IN ('R05', 'R06')"), msgs, markers).select(
        "sid", "idx", "rule", "key", F.lit(True).alias("auto_label")
    )
    auto = (
        label_r04(fires, msgs)
        .unionByName(label_r10(fires, msgs))
        .unionByName(flag_labels(fires))
        .unionByName(hindsight)
    )
    hand = labels_resolved(label_rows).select("rule", F.col("fire_key").alias("key"), F.col("applies").alias("hand"))
    judged = F.col("rule").isin(*STRATEGIES)
    told = fires.where(judged).join(auto, ["sid", "idx", "rule", "key"], "left").unionByName(
        fires.where(~judged).withColumn("auto_label", F.lit(None).cast("boolean")))
    return (
        told.join(hand, ["rule", "key"], "left")
        .select(
            "sid", "ts", "seq", "idx", "rule", "key", "why", "detail",
            basis_of(F.col("rule")).alias("basis"), "hand",
            F.coalesce("hand", "auto_label").alias("label"),
        )
    )


def precision_table(labelled: DataFrame, rules=tuple(V.BASIS)) -> DataFrame:
    """Per rule, including silent ones: counts, floor = confirmed/fires and labelled precision."""
    names = F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule")
    every = labelled.sparkSession.range(1).select(names)
    counts = labelled.groupBy("rule").agg(
        F.count("*").alias("fires"),
        F.count_if("label").alias("confirmed"),
        F.count_if(~F.col("label")).alias("refuted"),
        F.count_if(F.col("label").isNull()).alias("unknown"),
        F.countDistinct("sid").alias("sessions"),
        F.count("hand").alias("hand_labelled"),
    )
    zero = F.lit(0).cast("long")
    filled = every.join(counts, "rule", "left").select(
        "rule", basis_of(F.col("rule")).alias("basis"),
        *[F.coalesce(c, zero).alias(c) for c in
          ("fires", "confirmed", "refuted", "unknown", "sessions", "hand_labelled")],
    )
    judged = ~F.col("basis").isin("tautological", "manual", "none") | (F.col("hand_labelled") > 0)
    decided = F.col("confirmed") + F.col("refuted")
    return filled.select(
        "*",
        F.when(judged, F.bround(F.try_divide("confirmed", "fires"), 3)).alias("precision"),
        F.when(judged, F.bround(F.try_divide(F.col("confirmed"), decided), 3)).alias("precision_labelled"),
    )


def review_queue(fires: DataFrame, label_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Fires without a hand verdict, by rule and session; all of them unless a limit is asked for."""
    hand = labels_resolved(label_rows).select("rule", F.col("fire_key").alias("key"))
    todo = fires.join(hand, ["rule", "key"], "left_anti")
    ordered = todo.orderBy("rule", "sid", "idx", "key").select("sid", "idx", "rule", "key", "why", "detail")
    return ordered.limit(limit) if limit else ordered


def listed(fires: DataFrame, per_rule: int = 25) -> DataFrame:
    """The first fires of each rule, numbered ``n``."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule").orderBy("sid", "idx", "key")
    return fires.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_rule)


def labelled_some(fires: DataFrame, msgs: DataFrame, markers: DataFrame, label_rows: DataFrame) -> DataFrame:
    """``labelled_fires`` for a few of the fires: a label depends on the fire, its session's messages, the markers and
    the verdicts on its key, so nothing of other sessions and keys is prepared."""
    own = msgs.join(fires.select("sid").distinct(), "sid", "left_semi")
    keys = fires.select("rule", F.col("key").alias("fire_key")).distinct()
    return labelled_fires(fires, own, markers, label_rows.join(keys, ["rule", "fire_key"], "left_semi"))


def fire_list(labelled: DataFrame, per_rule: int = 25) -> DataFrame:
    """The first fires of each rule with a TP / FP / ?? mark."""
    mark = F.when(F.col("label"), "TP").when(~F.col("label"), "FP").otherwise("??")
    return (
        listed(labelled, per_rule)
        .select("rule", "n", mark.alias("mark"), X.message_id("sid", "idx").alias("message"), "key")
    )


def backtest_summary(msgs: DataFrame, label_rows: DataFrame) -> DataFrame:
    verdicts = labels_resolved(label_rows).agg(F.count("*").alias("verdicts"))
    totals = msgs.agg(F.countDistinct("sid").alias("sessions"), F.count("*").alias("messages"))
    return totals.select("sessions", "messages", verdicts.scalar().alias("verdicts"))
