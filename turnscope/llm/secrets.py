"""Secret scan: fixed patterns, and windows of high Shannon entropy inside long candidate strings.

A candidate is a run of key characters that mixes letters and digits. Its character class (hex digits, or the wider
key alphabet) sets the threshold. A window slides over it; the counts of its characters change by the one that
enters and the one that leaves, and with them the sum of ``c * log2(c)``, so the entropy costs the same at every step
whatever the window and wherever it stands: a text of millions of characters takes time in proportion. Windows above the threshold merge into spans. An allow-list suppresses candidates that are no
secrets: identifiers in UUID form, versions and dates, repeated characters, and listed strings.

Defined results: a null text counts as empty and has no spans; rows are scanned one by one, so repeated rows and ids
get equal results; only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm.columns import (
    SPANS, apart, chunks, count_of, let, matches, named, no_spans, piece, rendered, whole,
)

# fixed values: the patterns of the contract; possessive where that cannot change a match, against backtracking
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]++"
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]++"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@dataclass(frozen=True)
class EntropyOptions:
    window: int = 20
    hex_bits: float = 2.8
    key_bits: float = 3.6
    allowed: tuple[str, ...] = field(default_factory=tuple)  # exact strings that are known to be harmless
    # possessive: long candidates must not deepen the matcher's stack
    allowed_patterns: tuple[str, ...] = (
        UUID, r"[0-9]++(?:[-/_][0-9]++)*+", r"[A-Za-z]++(?:[-/_][A-Za-z]++)*+[0-9]{0,3}")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind. Texts without a kind's characters skip its pattern."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    assign = F.when(text.rlike("[:=]"), matches(text, ASSIGN, value)).otherwise(no_spans())
    access = F.when(text.contains("AKIA"), matches(text, ACCESS, lambda m: F.length(m) >= 20)).otherwise(no_spans())
    # shorter runs fail and are dropped, so only those of 24 and more need to be found
    hexes = F.when(text.rlike("[0-9a-f]{24}"), matches(text, r"[0-9a-f]{24,}+", lambda m: F.lit(True)))
    found = F.concat(named("assign", 0, assign), named("access", 1, access), named("hex", 2, hexes.otherwise(no_spans())))
    return F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["k"].alias("k"), x["e"].alias("e"))))


SEGMENT = 2000  # characters of a candidate that one fold passes over


def window_spans(candidate: Column, options: EntropyOptions) -> Column:
    """Merged spans, relative to the candidate, of windows whose entropy reaches the threshold of its class.

    A long candidate is folded in segments, each with the window before it, so that what a fold has gathered (and Spark
    copies at every step) stays small. Spans of neighbouring segments that touch are one.
    """
    w = options.window
    is_hex = candidate.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")
    bits = F.when(is_hex, F.lit(options.hex_bits)).otherwise(F.lit(options.key_bits))
    size = F.length(candidate)

    def segments(parts: Column, threshold: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((size - 1) / SEGMENT).cast("int") * SEGMENT, F.lit(SEGMENT))
        return F.flatten(F.transform(starts, lambda at: let(F.greatest(at - w + 1, F.lit(0)), lambda first: F.transform(
            segment_spans(piece(parts, first, F.least(at + SEGMENT, size) - first), threshold, w),
            lambda x: F.struct((x["s"] + first).alias("s"), (x["e"] + first).alias("e"))))))

    return let(bits, lambda threshold: let(chunks(candidate), lambda parts: let(segments(parts, threshold), touching)))


def touching(spans: Column) -> Column:
    """Spans in order, of which touching or overlapping neighbours become one."""
    begins = F.filter(spans, lambda x, i: (i == 0) | (F.get(spans, i - 1)["e"] < x["s"]))
    ends = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["s"] > x["e"]))
    return F.zip_with(begins, ends, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))


def segment_spans(text: Column, threshold: Column, w: int) -> Column:
    """One pass: every step changes two counters, those of the code that enters and of the one that leaves."""
    table = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(w + 2)])
    log_sum = lambda c: F.get(table, c)
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x))

    def moves(codes: Column) -> Column:
        gone = F.slice(F.concat(F.array_repeat(F.lit(0), w), codes), F.lit(1), F.size(codes))
        return F.zip_with(codes, gone, lambda x, y: F.struct(x.alias("enters"), y.alias("leaves")))

    def step(acc: Column, move: Column) -> Column:
        enters, leaves, i = move["enters"], move["leaves"], acc["i"]
        more, fewer = F.get(acc["n"], enters), F.get(acc["n"], leaves)
        same = enters == leaves
        total = F.when(same, acc["sum"]).otherwise(
            acc["sum"] - log_sum(more) + log_sum(more + 1)
            - F.when(leaves > 0, log_sum(fewer) - log_sum(fewer - 1)).otherwise(F.lit(0.0)))
        counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda c, j:
            F.when(j == enters, c + 1).when((j == leaves) & (leaves > 0), c - 1).otherwise(c)))
        return F.struct((i + 1).alias("i"), counts.alias("n"), total.alias("sum"),
                        *opened(acc, (i >= w - 1) & (F.lit(math.log2(w)) - total / w >= threshold)))

    def opened(acc: Column, hit: Column) -> list[Column]:
        """The open span with the window that ends here, or a new one; what it replaces is closed."""
        start = acc["i"] - w + 1
        begins = hit & (acc["e"] < start)
        closed = F.array_append(acc["spans"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))
        return [F.when(begins, start).otherwise(acc["s"]).alias("s"),
                F.when(hit, acc["i"] + 1).otherwise(acc["e"]).alias("e"),
                F.when(begins & (acc["e"] > 0), closed).otherwise(acc["spans"]).alias("spans")]

    zero = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("sum"),
        F.lit(-1).alias("s"), F.lit(-1).alias("e"), no_spans().alias("spans"))
    end = lambda acc: F.when(acc["e"] > 0, F.array_append(
        acc["spans"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))).otherwise(acc["spans"])
    return F.aggregate(let(codes, moves), zero, step, end)


def suppressed(candidate: Column, options: EntropyOptions) -> Column:
    listed = candidate.isin(*options.allowed) if options.allowed else F.lit(False)
    for pattern in options.allowed_patterns:
        listed = listed | candidate.rlike(f"^(?:{pattern})$")
    return listed | ~(candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]"))


def entropy_spans(text: Column, options: EntropyOptions) -> Column:
    """High-entropy spans of the text, by start."""
    long_enough = lambda m: (F.length(m) >= options.window) & ~suppressed(m, options)
    # only long runs count, and a possessive run is tried once, so shorter ones may be passed over
    pattern = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{options.window},}}+"
    candidates = matches(text, pattern, long_enough)
    spans = let(chunks(text), lambda parts: F.flatten(F.transform(candidates, lambda c: F.transform(
        let(piece(parts, c["s"], c["e"] - c["s"]), lambda x: window_spans(x, options)),
        lambda x: F.struct((x["s"] + c["s"]).alias("s"), (x["e"] + c["s"]).alias("e"))))))
    mixed = text.rlike(f"(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{{options.window}}}")
    return F.when(mixed, spans).otherwise(no_spans()).cast(SPANS)


def scan(docs: DataFrame, options: EntropyOptions = EntropyOptions(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the base spans, and the entropy spans that no base span overlaps."""
    body = whole(F.col(text))
    found = docs.select(*keep, base_spans(body).alias("base"), entropy_spans(body, options).alias("entropy"))
    fresh = F.when(F.size("entropy") > 0, apart(F.col("entropy"), F.col("base"))).otherwise(no_spans())
    extra = F.transform(fresh, lambda x: F.struct(
        x["s"].alias("s"), F.lit(3).alias("o"), F.lit("entropy").alias("k"), x["e"].alias("e")))
    return found.select(*keep, "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
