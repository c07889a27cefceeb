"""The rule catalogue: one small table of rules plus engine settings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions import vocab as V

PACKAGED = Path(__file__).with_name("rules.json")

SCHEMA = """
rules array<struct<
  id string, action string, suspended boolean, suspended_reason string,
  params map<string, double>,
  metrics struct<precision double, backtest struct<
    basis string, refuted bigint, hand_labelled bigint>>,
  fix string>>,
engine string
"""


def flatten(doc: DataFrame) -> DataFrame:
    """One row per rule. ``fix`` is a template, or an object whose ``fallback`` is one."""
    r = F.explode("rules").alias("r")
    rows = doc.select(r)
    fallback = F.get_json_object("r.fix", "$.fallback")
    is_object = F.startswith(F.col("r.fix"), F.lit("{\""))
    return rows.select(
        F.col("r.id").alias("rule"),
        F.col("r.action").alias("action"),
        F.coalesce("r.suspended", F.lit(False)).alias("suspended"),
        F.col("r.suspended_reason").alias("suspended_reason"),
        F.col("r.params").alias("params"),
        F.col("r.metrics.precision").alias("precision"),
        F.col("r.metrics.backtest.basis").alias("basis"),
        F.coalesce("r.metrics.backtest.refuted", F.lit(0).cast("long")).alias("refuted"),
        F.coalesce("r.metrics.backtest.hand_labelled", F.lit(0).cast("long")).alias("hand_labelled"),
        F.when(is_object, fallback).otherwise(F.col("r.fix")).alias("template"),
    )


def scan_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Read a catalogue file from any path Spark can reach."""
    return flatten(spark.read.schema(SCHEMA).json(path, multiLine=True))


def packaged(spark: SparkSession) -> DataFrame:
    """The catalogue shipped with the package, sent inline so that executors need no local file."""
    text = json.dumps(json.loads(PACKAGED.read_text()))
    doc = spark.range(1).select(F.from_json(F.lit(text), SCHEMA).alias("d")).select("d.*")
    return flatten(doc)


def engine_setting(path: str, default: float) -> float:
    """One dotted setting of the packaged catalogue; missing, null or malformed gives the default."""
    node = json.loads(PACKAGED.read_text()).get("engine")
    for part in path.split("."):
        if not isinstance(node, dict) or part not in node:
            return default
        node = node[part]
    return node if isinstance(node, type(default)) else default


def ask_budget() -> int:
    return engine_setting("max_asks_per_session", V.MAX_ASKS_PER_SESSION)


def params_of(catalogue: DataFrame) -> dict[tuple[str, str], float]:
    """The trigger parameters by (rule, name): a dozen rows on the driver."""
    return {(r["rule"], r["name"]): r["value"] for r in rule_params(catalogue).collect()}


def rule_params(catalogue: DataFrame) -> DataFrame:
    """Every trigger parameter: the catalogue's value, else the built-in default."""
    given = catalogue.where("params IS NOT NULL").select("rule", F.explode("params").alias("name", "given"))
    rows = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(n).alias("name"), F.lit(v).alias("default"))
        for (r, n), v in V.DEFAULT_PARAMS.items()
    ])
    defaults = catalogue.sparkSession.range(1).select(F.inline(rows))
    return given.join(defaults, ["rule", "name"], "full").select(
        "rule", "name", F.coalesce("given", "default").alias("value")
    )


def action(ceiling: float | None = None, floor: float | None = None) -> Column:
    """What to do with a rule's fires, from its declared action and measured precision.

    Bounds that are not given come from the catalogue's engine settings.
    """
    ceiling = engine_setting("precision_ceiling", V.PRECISION_CEILING) if ceiling is None else ceiling
    floor = engine_setting("precision_floor", V.PRECISION_FLOOR) if floor is None else floor
    trusted = (F.col("basis") == V.TRUSTED_BASIS) | (F.col("hand_labelled") > 0)
    measured = F.col("precision").isNotNull() & F.coalesce(trusted, F.lit(False))
    return (
        F.when(F.col("suspended"), "log")
        .when(F.col("action").isin("augment", "annotate", "resend"), "augment")
        .when(measured & (F.col("precision") >= ceiling), "apply")
        .when(measured & (F.col("precision") < floor) & (F.col("refuted") > 0), "log")
        .otherwise("ask")
    )


def rule_actions(catalogue: DataFrame) -> DataFrame:
    """Runtime action per registered rule; a rule missing from the catalogue is skipped."""
    names = F.explode(F.array(*[F.lit(r) for r in V.BASIS])).alias("rule")
    registered = catalogue.sparkSession.range(1).select(names)
    known = catalogue.select("rule", action().alias("runtime_action"))
    return registered.join(known, "rule", "left").select(
        "rule", F.coalesce("runtime_action", F.lit("skip")).alias("runtime_action")
    )


def asking_rules(catalogue: DataFrame) -> list[str]:
    """Rules whose fires may ask and wait for a verdict: a dozen rows on the driver at most."""
    asks = catalogue.where(~action().isin("augment", "log", "skip") & F.col("template").isNotNull())
    return [r["rule"] for r in asks.select("rule").distinct().collect()]


def deduped_rules() -> tuple[str, ...]:
    """Rules of the packaged catalogue surfaced once per cause: everything that is not augment."""
    rules = json.loads(PACKAGED.read_text())["rules"]
    silent = ("augment", "annotate", "resend")
    return tuple(r["id"] for r in rules if r.get("suspended") or r["action"] not in silent)


def with_metrics(catalogue: DataFrame, precision: DataFrame) -> DataFrame:
    """Fold fresh backtest results in; rules without results keep what they had."""
    fresh = precision.select(
        "rule", F.lit(True).alias("_fresh"), F.col("precision").alias("_precision"),
        F.col("basis").alias("_basis"), F.col("refuted").alias("_refuted"),
        F.col("hand_labelled").alias("_hand"),
    )
    joined = catalogue.join(fresh, "rule", "left")
    new = F.col("_fresh").isNotNull()
    return joined.select(
        "rule", "action", "suspended", "suspended_reason", "params",
        F.when(new, F.col("_precision")).otherwise(F.col("precision")).alias("precision"),
        F.when(new, F.col("_basis")).otherwise(F.col("basis")).alias("basis"),
        F.when(new, F.col("_refuted")).otherwise(F.col("refuted")).alias("refuted"),
        F.when(new, F.col("_hand")).otherwise(F.col("hand_labelled")).alias("hand_labelled"),
        "template",
    )


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one catalogue version and not in the other."""
    columns = ["rule", "action", "suspended", "precision", "basis", "refuted", "hand_labelled", "template"]
    a, b = left.select(columns), right.select(columns)
    only_a = a.exceptAll(b).withColumn("side", F.lit("left"))
    only_b = b.exceptAll(a).withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def routing_buckets(catalogue: DataFrame) -> DataFrame:
    """Rule ids per action; logged rules split into demoted and suspended, with the reason."""
    acted = catalogue.withColumn("runtime_action", action())
    bucket = F.when(
        F.col("runtime_action") == "log",
        F.when(F.col("suspended"), "suspended").otherwise("floored"),
    ).otherwise(F.col("runtime_action"))
    reason = F.when(F.col("suspended"), F.concat("rule", F.lit(": "), F.split("suspended_reason", r"\.")[0]))
    return acted.groupBy(bucket.alias("bucket")).agg(
        F.array_join(F.array_sort(F.collect_list("rule")), " ").alias("rules"),
        F.array_join(F.array_sort(F.collect_list(reason)), "; ").alias("reasons"),
    )
