"""Column expressions shared by the operators: bindings, words, and spans of pattern matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # what separates words
SPANS = "array<struct<s:int,e:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Spark inlines a projected column into the lambda that reads it, which would evaluate it anew for every
    element; a bound variable is not inlined.
    """
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in joins and groups."""
    return F.md5(whole(text))


def matches(text: Column, pattern: str, passes: Callable[[Column], Column]) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches for which ``passes``.

    The texts between matches and the matches take turns, so their lengths add up to the positions. Costs grow with
    the text and the number of matches, not with their product.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")),
    )

    size = lambda pair: pair["gap"] + F.coalesce(F.length(pair["found"]), F.lit(0))
    span = lambda at, pair: F.struct((at + pair["gap"]).alias("s"), (at + size(pair)).alias("e"))
    return swept(pairs, 0, lambda at, pair: at + size(pair), lambda a, b: a + b, span,
                 lambda at, pair: pair["found"].isNotNull() & passes(pair["found"]))


PART = 128


def swept(
    items: Column, zero: int, step: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column],
    span: Callable[[Column, Column], Column], wanted: Callable[[Column, Column], Column],
) -> Column:
    """Spans made from the items in order and a running number, for the items that are ``wanted``.

    ``aggregate`` copies all it has gathered at every step, so that one over the whole array would cost the square of
    it. Parts of ``PART`` items are folded each for itself, what they come to is combined, and every part is
    swept once more from the number at which it begins.
    """
    def parts(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / PART).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(
            F.sequence(i * PART, F.least((i + 1) * PART, F.size(all_)) - 1), lambda j: F.get(all_, j)))

    def begun(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), step))
        return F.aggregate(ends, F.array(F.lit(zero)), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x)))

    def one(part: Column, start: Column) -> Column:
        def more(acc: Column, x: Column) -> Column:
            grown = F.when(wanted(acc["at"], x), F.array_append(acc["spans"], span(acc["at"], x)))
            return F.struct(step(acc["at"], x).alias("at"), grown.otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(part, F.struct(start.alias("at"), no_spans().alias("spans")), more, lambda acc: acc["spans"])

    made = let(items, lambda x: let(parts(x), lambda p: F.flatten(F.zip_with(
        p, F.slice(begun(p), F.lit(1), F.size(p)), one))))
    return made


CHUNK = 512


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, from which ``piece`` cuts: ``substring`` walks from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def piece(parts: Column, start: Column, size: Column) -> Column:
    """``size`` code points of a text in ``chunks``, from ``start`` on."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.floor(F.greatest(size - 1, F.lit(0)) / CHUNK).cast("int") + 2), "")
    return F.substring(held, start - first * CHUNK + 1, size)


def apart(spans: Column, others: Column) -> Column:
    """The spans (s, e) that overlap none of the others, by start: two sweeps over both in order of their starts."""
    marked = lambda x, own: F.transform(x, lambda y: F.struct(y["s"].alias("s"), F.lit(own).alias("own"), y["e"].alias("e")))
    span = lambda edge, x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    own = lambda x: x["own"] == 1

    def behind(x: Column) -> Column:
        """Spans that no other one reaches from before; there is at least one of either kind."""
        both = F.array_sort(F.concat(marked(others, 0), marked(x, 1)))
        return swept(both, -1, lambda edge, y: F.when(own(y), edge).otherwise(F.greatest(edge, y["e"])), F.greatest, span,
                     lambda edge, y: own(y) & (y["s"] >= edge))

    def ahead(x: Column) -> Column:
        both = F.reverse(F.array_sort(F.concat(marked(others, 0), marked(x, 1))))
        return swept(both, (1 << 31) - 1, lambda edge, y: F.when(own(y), edge).otherwise(F.least(edge, y["s"])), F.least, span,
                     lambda edge, y: own(y) & (y["e"] <= edge))

    some = (F.size(spans) > 0) & (F.size(others) > 0)
    return F.when(some, F.array_sort(let(behind(spans), ahead))).otherwise(spans)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def named(kind: str, order: int, spans: Column) -> Column:
    """Spans with their kind and its place in the order of kinds."""
    return F.transform(spans, lambda x: F.struct(
        F.lit(order).alias("o"), F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def rendered(spans: Column) -> Column:
    """``kind:start:end``, joined by commas in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")
