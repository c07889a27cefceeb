"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The spans of the fixed patterns are the seeds. The words around them are lexical patterns; the same patterns around
other identifier-like tokens (with four digits or an ``@``) tie those tokens to the seeds. Spark scores this graph in
rounds: a pattern is as good as the share of its distinct instances that are believed to be of a kind, an instance
as good as the noisy-or of its accepted patterns. Instances believed in one round count as evidence in the next.
In the end the accepted instances are spans of their kind wherever they stand in an accepted pattern.

Support counts distinct values in distinct texts, so copies of a text cannot vouch for each other.

Defined results: a null text counts as empty and has no spans; rows are found by their text, so repeated rows and ids
get equal results; with no seeds or empty tables only the fixed patterns count; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm.columns import (
    apart, chunks, count_of, let, matches, named, no_spans, piece, rendered, text_key, whole,
)
from turnscope.session import materialize

# fixed values: the patterns of the contract. Possessive, and not begun inside a run that was tried already: neither
# can change a match, both keep long texts linear and the matcher's stack flat.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

CONTEXT = 80  # code points on each side in which the neighbouring words are looked for


@dataclass(frozen=True)
class BootstrapOptions:
    rounds: int = 3
    min_support: int = 4  # distinct believed values a pattern needs
    min_pattern: float = 0.6
    min_instance: float = 0.85


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by kind, then start. Texts without a kind's characters skip its pattern."""
    def at_hand(wanted: Column, pattern: str, passes) -> Column:
        return F.when(wanted, matches(text, pattern, passes)).otherwise(no_spans())

    card = lambda m: let(digits(m), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    spans = {
        "email": at_hand(text.contains("@"), EMAIL, lambda m: F.lit(True)),
        "ip": at_hand(text.rlike(r"[0-9]\.[0-9]"), IP, lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": at_hand(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD, card),
        "phone": at_hand(text.rlike(r"\+[0-9]"), PHONE, lambda m: F.length(digits(m)).between(8, 15)),
    }
    return F.concat(*[named(k, i, spans[k]) for i, k in enumerate(KINDS)])


def identifier_tokens(text: Column) -> Column:
    """Spans of tokens that look like identifiers: four digits or an ``@``, without the punctuation around them."""
    token = r"(?:(?<![A-Za-z0-9@._+-])|\G)[A-Za-z0-9@._+-]++"
    found = matches(text, token, lambda m: m.rlike("@") | (F.length(digits(m)) >= 4))
    return F.when(text.rlike("@|[0-9][^0-9\\s]{0,3}[0-9]"), found).otherwise(no_spans())


def instances(docs: DataFrame) -> DataFrame:
    """One row per seed or candidate of every distinct text: key, kind (null: candidate), s, e, value, patterns."""
    known = F.when(F.size("base") > 0, apart(F.col("tokens"), F.col("base"))).otherwise(F.col("tokens"))
    every = F.concat("base", F.transform(known, lambda t: F.struct(
        F.lit(9).alias("o"), F.lit(None).cast("string").alias("k"), t["s"].alias("s"), t["e"].alias("e"))))
    n = F.lit(CONTEXT)
    around = let(chunks(F.col("text")), lambda parts: F.transform(every, lambda x: F.struct(
        x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), piece(parts, x["s"], x["e"] - x["s"]).alias("value"),
        piece(parts, F.greatest(x["s"] - n, F.lit(0)), F.least(x["s"], n)).alias("before"), piece(parts, x["e"], n).alias("after"))))
    texts = docs.where(F.col("has")).select("key", F.explode(around).alias("x"))
    before, after, s, e = F.col("x.before"), F.col("x.after"), F.col("x.s"), F.col("x.e")
    left = F.regexp_extract(F.lower(before), r"(\S+)\s+(\S+)\s*$", 0)
    word_left = F.regexp_extract(F.lower(before), r"(\S+)\s*$", 1)
    word_right = F.regexp_extract(F.lower(after), r"^\s*(\S+)", 1)
    made = F.array(F.concat(F.lit("l2 "), left), F.concat(F.lit("lr "), word_left, F.lit(" _ "), word_right))
    told = F.array(left != "", (word_left != "") & (word_right != ""))
    patterns = F.transform(F.filter(F.arrays_zip(made.alias("p"), told.alias("ok")), lambda x: x["ok"]), lambda x: x["p"])
    return texts.select(
        "key", F.col("x.k").alias("kind"), s.alias("s"), e.alias("e"),
        F.lower("x.value").alias("value"), patterns.alias("patterns"))


def bootstrap(found: DataFrame, options: BootstrapOptions) -> DataFrame:
    """Spans (key, kind, s, e) of candidates that the graph of patterns and instances vouches for."""
    edges = materialize(
        found.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value")
        .agg(F.max("kind").alias("seed")), "pii-edges")
    believed = edges.where(F.col("seed").isNotNull()).groupBy("value").agg(
        F.max("seed").alias("kind"), F.lit(1.0).alias("conf"))
    seeds = believed
    patterns = None
    for _ in range(options.rounds):
        sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
        scored = edges.join(believed, "value").groupBy("pattern", "kind").agg(
            F.sum("conf").alias("mass"), F.count("*").alias("support"))
        patterns = materialize(
            scored.where(F.col("support") >= options.min_support).join(sizes, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("size") + 1)).alias("score"))
            .where(F.col("score") >= options.min_pattern), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        per_kind = edges.where(F.col("seed").isNull()).join(patterns, "pattern").groupBy("value", "kind").agg(
            (1 - doubt).alias("conf"))
        best = per_kind.groupBy("value").agg(
            F.max(F.struct("conf", "kind")).alias("x")).select("value", "x.kind", "x.conf")
        new = best.where(F.col("conf") >= options.min_instance)
        believed = materialize(seeds.unionByName(new.join(seeds, "value", "left_anti")), "pii-believed")
    places = found.where(F.col("kind").isNull()).select("key", "s", "e", "value", F.explode("patterns").alias("pattern"))
    accepted = places.join(patterns, "pattern").join(believed, ["value", "kind"])
    return accepted.select("key", "kind", "s", "e").distinct()


def scan(docs: DataFrame, options: BootstrapOptions = BootstrapOptions()) -> DataFrame:
    """doc_id, base spans and all spans of every row, each by kind, then start."""
    body = whole(F.col("text"))
    read = docs.select("doc_id", text_key(F.col("text")).alias("key"), body.alias("text"))
    base = materialize(read.select(
        "doc_id", "key", base_spans(F.col("text")).alias("base"), identifier_tokens(F.col("text")).alias("tokens")),
        "pii-base")
    told = base.where((F.size("base") > 0) | (F.size("tokens") > 0))
    once = told.groupBy("key").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens"))
    texts = read.select("key", "text").where(F.col("text").rlike("[0-9@]"))
    found = materialize(instances(
        texts.groupBy("key").agg(F.first("text").alias("text")).join(once, "key").withColumn("has", F.lit(True))), "pii-instances")
    extra = bootstrap(found, options).groupBy("key").agg(F.collect_list(F.struct(
        functools.reduce(lambda c, ik: c.when(F.col("kind") == ik[1], ik[0]), enumerate(KINDS), F.when(F.lit(False), 0)).alias("o"),
        F.col("kind").alias("k"), "s", "e")).alias("extra"))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<o:int,k:string,s:int,e:int>>"))),
                                     lambda x: F.struct(x["o"].alias("o"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return base.join(extra, "key", "left").select("doc_id", "base", spans.alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
