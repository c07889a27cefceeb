"""Quality rules: an ordered decision list learned by sequential covering, applied as one conditional expression.

Each rule is a conjunction of thresholds on statistics of the text and rejects what it matches; what no rule
matches is kept. A rule grows on one part of the labelled rows by the condition of highest information gain, is
pruned on another part, and is taken only if it is precise there. Rows it covers leave both parts.

Defined results: a null text counts as empty; labels that are null or have no document are ignored; without both
labels in the sample, or in empty tables, the list is empty and only the fixed minimum decides. Rows are judged one
by one, so repeated rows get equal verdicts; a column of ``docs`` named like a result column is replaced.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm.columns import let, whole, words
from turnscope.session import materialize

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
MIN_WORDS = 50
FEATURES = (
    "n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "capital_share",
    "exclaim_share", "words_per_line",
)


@dataclass(frozen=True)
class FitOptions:
    """Bounds of the fit. ``max_rows`` labelled rows at most are expected in the sample (drawn by a hash of the id)."""

    max_rows: int = 20_000
    cuts: int = 48  # quantiles of a feature; thresholds lie halfway between different ones
    max_rules: int = 8
    max_conditions: int = 3
    min_precision: float = 0.9
    min_covered: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def repeated_words(n: Column, w: Column) -> Column:
    """Words in three-word windows found twice or more.

    Hashes tell whether any window can repeat; only then are the windows themselves sorted, and equal neighbours
    give the starts of repeated windows.
    """
    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))),
                          lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda x, y: x + y))

    def equal_starts(ordered: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)["win"].eqNullSafe(x["win"])
            return before | F.get(ordered, i + 1)["win"].eqNullSafe(x["win"])

        return F.sort_array(F.transform(F.filter(ordered, repeated), lambda x: x["at"]))

    at = F.sequence(F.lit(0), n - 3)
    hashed = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    windows = F.transform(at, lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("win"), i.alias("at")))
    may_repeat = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    exact = let(F.sort_array(windows), lambda o: let(equal_starts(o), covered))
    return F.when(n < 4, F.lit(0)).when(may_repeat, exact).otherwise(F.lit(0))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the base counts and the features of every whole text."""
    body = whole(F.col(text))

    def counted(chars: str) -> Column:
        return F.length(body) - F.length(F.translate(body, chars, ""))

    spoken = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(body), lambda w: F.struct(
        F.size(w).alias("n"),
        F.length(F.array_join(w, "")).alias("chars"),
        repeated_words(F.size(w), w).alias("repeat"),
        F.size(F.array_distinct(w)).alias("distinct"),
    ))
    of_lines = let(spoken, lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    raw = docs.select(
        *[F.col(c) for c in keep], of_words.alias("_w"), of_lines.alias("_l"), counted(SYMBOLS).alias("_symbols"),
        counted(CAPITALS).alias("_capitals"), counted("!").alias("_exclaims"),
    )
    n, chars = F.col("_w.n"), F.col("_w.chars")

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(F.lit(0.0))

    failed = (n < MIN_WORDS) | (100 * F.col("_w.repeat").cast("long") > 50 * n.cast("long"))
    return raw.select(
        *[F.col(c) for c in keep],
        n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"), F.col("_l.dup").cast("long").alias("n_dup_lines"),
        F.col("_w.repeat").cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
        share(chars, n).alias("word_length"), share(F.col("_symbols"), chars).alias("symbol_share"),
        share(F.col("_l.dup"), F.col("_l.n")).alias("dup_line_share"),
        share(F.col("_w.repeat"), n).alias("repeat_share"), share(F.col("_w.distinct"), n).alias("distinct_share"),
        share(F.col("_capitals"), chars).alias("capital_share"), share(F.col("_exclaims"), chars).alias("exclaim_share"),
        share(n, F.col("_l.n")).alias("words_per_line"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, options: FitOptions) -> DataFrame:
    """Statistics of at most about ``max_rows`` labelled documents, with label and part (3 in 4 grow, the rest prune).

    The sampled ids number ``max_rows`` at most in expectation, whatever the corpus, so they may be broadcast.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    share = min(1.0, options.max_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.where(draw < math.ceil(share * 1_000_000)).select("doc_id", "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(texts, keep=("doc_id", "quality"))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(4))
    return rows.select(*FEATURES, "base_failed", (F.col("quality") == 0).alias("bad"), (part > 0).alias("grows"))


def all_of(rule: Rule) -> Column:
    return functools.reduce(operator.and_, [c.column() for c in rule], F.lit(True))


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained about the covered bad rows by narrowing (p0, n0) to (p, n)."""
    return p * (math.log2((p + 1) / (p + n + 1)) - math.log2((p0 + 1) / (p0 + n0 + 1)))


def learn(sample: DataFrame, options: FitOptions = FitOptions()) -> list[Rule]:
    """The decision list. Each step is one aggregate over the sample; only counts reach the driver."""
    steps = [i / (options.cuts + 1) for i in range(1, options.cuts + 1)]
    row = sample.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first()
    if row is None or row[FEATURES[0]] is None:
        return []
    seen = {f: sorted({float(x) for x in row[f]}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in pairwise(values)] for f, values in seen.items()}
    binned = F.array(*[
        F.struct(F.lit(f).alias("f"), sum([(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias("b"))
        for f in FEATURES
    ])
    rules: list[Rule] = []
    while len(rules) < options.max_rules:
        rest = sample.where(~functools.reduce(operator.or_, [all_of(r) for r in rules], F.lit(False)))
        rule: Rule = ()
        while len(rule) < options.max_conditions:
            counts = (
                rest.where(F.col("grows") & all_of(rule)).select("bad", F.explode(binned).alias("x"))
                .groupBy("x.f", "x.b").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.count("*").alias("m")).collect()
            )
            best = best_condition({(r.f, r.b): (r.p, r.m - r.p) for r in counts}, cuts, options.min_covered)
            if best is None:
                break
            rule += (best,)
        rule = pruned(rest.where(~F.col("grows")), rule, options)
        if not rule:
            break
        rules.append(rule)
    return rules


def best_condition(counts: dict, cuts: dict[str, list[float]], least: int) -> Condition | None:
    """The condition of highest gain; ties go to the first feature and the lowest cut."""
    best, best_gain = None, 1e-9
    for f in FEATURES:
        bins = [counts.get((f, b), (0, 0)) for b in range(len(cuts[f]) + 1)]
        p0, n0 = sum(p for p, _ in bins), sum(n for _, n in bins)
        p_low = n_low = 0
        for b, cut in enumerate(cuts[f]):
            p_low, n_low = p_low + bins[b][0], n_low + bins[b][1]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                if p >= least and n < n0 and (g := gain(p, n, p0, n0)) > best_gain:
                    best, best_gain = Condition(f, above, cut), g
    return best


def pruned(part: DataFrame, rule: Rule, options: FitOptions) -> Rule:
    """The prefix of the rule that is most precise on the pruning part; none if even that is not precise enough."""
    if not rule:
        return ()
    prefixes = [rule[: i + 1] for i in range(len(rule))]
    row = part.agg(*[
        F.count(F.when(all_of(r) & (F.col("bad") == wanted), 1)).alias(f"{name}{i}")
        for i, r in enumerate(prefixes) for name, wanted in (("p", True), ("n", False))
    ]).first()
    worth = [((row[f"p{i}"] - row[f"n{i}"]) / max(1, row[f"p{i}"] + row[f"n{i}"]), row[f"p{i}"], -i) for i in range(len(prefixes))]
    value, covered, at = max(worth)
    return prefixes[-at] if covered >= 1 and (value + 1) / 2 >= options.min_precision else ()


def matched_rule(rules: list[Rule]) -> Column:
    """Ordered conditional: the number of the first rule that matches, null where none does."""
    chosen = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        chosen = F.when(all_of(rule), F.lit(i)).otherwise(chosen)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, options: FitOptions = FitOptions()) -> list[Rule]:
    sample = materialize(labelled_sample(docs, labels, options), "quality-sample")
    return learn(sample.where(~F.col("base_failed")), options)


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, the base test, the first matching rule and the verdict for every row."""
    stats = statistics(docs, keep=keep)
    first = matched_rule(rules)
    return stats.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        first.alias("rule"), (~F.col("base_failed") & first.isNull()).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    passes = ~F.col("base_failed") & matched_rule(rules).isNull()
    # behind a generator the verdict is computed once; a plain filter would be pushed down and repeat the statistics
    judged = statistics(inner, keep=("row",)).select("row", F.explode(F.array(passes)).alias("passes"))
    return judged.where("passes").select("row.*")
