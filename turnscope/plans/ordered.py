"""Ordered per-group scans that survive a group holding a third of all rows.

A plain window over ``partitionBy(session)`` puts a whole session into one task. Here a session
above ``turnscope.hotRows`` rows is cut into time chunks: windows run inside (session, chunk), each
chunk is pre-aggregated to one row, and what earlier chunks contribute is added by an equi join.
Ordinary sessions have ``chunk IS NULL`` and behave as under a plain window. When a count per
session shows that none is hot, ``chunk`` has type VOID and every later scan is a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("turnscope.hotRows", str(HOT_ROWS)))


ISO_WIDTHS = (16, 19, 23)  # minute, second and millisecond prefixes of an ISO timestamp


def with_chunks(
    df: DataFrame,
    key: str = "sid",
    order: str = "ts",
    widths: tuple[int, int, int] = ISO_WIDTHS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``chunk``: NULL for ordinary groups, a prefix of the order string for hot ones.

    A prefix of a string is monotone in that string, so chunks never interleave; the hotter the
    group, the longer the prefix. One count per group is run here to learn whether any group is
    hot; ``sizes`` may name a cheaper frame with the same key column and row counts. Every hot group
    is cut, however many there are; Spark decides by their measured number how they are joined.
    """
    limit = hot_rows(df)
    hot = (
        (df if sizes is None else sizes).groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > limit)
        .select(
            key,
            F.when(F.col("_n") > 1000 * limit, widths[2])
            .when(F.col("_n") > 10 * limit, widths[1])
            .otherwise(widths[0]).alias("_width"),
        )
    )
    if hot.isEmpty():
        return df.withColumn("chunk", F.lit(None))
    return (
        df.join(hot, key, "left")
        .withColumn("chunk", F.expr(f"substring({order}, 1, _width)"))
        .drop("_width")
    )


def is_chunked(df: DataFrame, chunk: str = "chunk") -> bool:
    return not isinstance(df.schema[chunk].dataType, T.NullType)


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    peers: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    chunk: str = "chunk",
) -> DataFrame:
    """Add columns that describe the group around each row, never including the row itself
    unless stated.

    sums    sum over rows strictly before
    lasts   latest non-null value strictly before
    nexts   earliest non-null value strictly after
    peers   sum over rows whose first order column is not greater (equal ones included)
    totals  sum over the whole group
    maxes   maximum over the whole group
    """
    sums, lasts, nexts = dict(sums or {}), dict(lasts or {}), dict(nexts or {})
    peers, totals, maxes = dict(peers or {}), dict(totals or {}), dict(maxes or {})
    chunked = is_chunked(df, chunk)
    keys = [*by, chunk] if chunked else [*by]
    asc = Window.partitionBy(*keys).orderBy(*order)
    desc = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    after = desc.rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order[0]).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    mark = "_{}_{}" if chunked else "{1}"

    local = df.select(
        "*",
        *[F.coalesce(F.sum(e).over(before), zero).alias(mark.format("s", n)) for n, e in sums.items()],
        *[F.coalesce(F.sum(e).over(upto), zero).alias(mark.format("p", n)) for n, e in peers.items()],
        *[F.last(e, True).over(before).alias(mark.format("l", n)) for n, e in lasts.items()],
        *[F.last(e, True).over(after).alias(mark.format("n", n)) for n, e in nexts.items()],
        *[F.coalesce(F.sum(e).over(whole), zero).alias(mark.format("t", n)) for n, e in totals.items()],
        *[F.max(e).over(whole).alias(mark.format("m", n)) for n, e in maxes.items()],
    )
    if not chunked:
        return local

    position = F.struct(*order)

    def present(e: Column) -> Column:
        return F.when(e.isNotNull(), position)

    per_chunk = (
        df.where(F.col(chunk).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_rows"),
            *[F.coalesce(F.sum(e), zero).alias(f"_s_{n}") for n, e in sums.items()],
            *[F.coalesce(F.sum(e), zero).alias(f"_p_{n}") for n, e in peers.items()],
            *[F.max_by(e, present(e)).alias(f"_l_{n}") for n, e in lasts.items()],
            *[F.min_by(e, present(e)).alias(f"_n_{n}") for n, e in nexts.items()],
            *[F.coalesce(F.sum(e), zero).alias(f"_t_{n}") for n, e in totals.items()],
            *[F.max(e).alias(f"_m_{n}") for n, e in maxes.items()],
        )
    )
    c_asc = Window.partitionBy(*by).orderBy(chunk)
    c_desc = Window.partitionBy(*by).orderBy(F.col(chunk).desc())
    c_before = c_asc.rowsBetween(Window.unboundedPreceding, -1)
    c_after = c_desc.rowsBetween(Window.unboundedPreceding, -1)
    c_whole = Window.partitionBy(*by)
    carried = per_chunk.select(
        *keys,
        *[F.sum(f"_s_{n}").over(c_before).alias(f"_cs_{n}") for n in sums],
        *[F.sum(f"_p_{n}").over(c_before).alias(f"_cp_{n}") for n in peers],
        *[F.last(f"_l_{n}", True).over(c_before).alias(f"_cl_{n}") for n in lasts],
        *[F.last(f"_n_{n}", True).over(c_after).alias(f"_cn_{n}") for n in nexts],
        *[F.sum(f"_t_{n}").over(c_whole).alias(f"_ct_{n}") for n in totals],
        *[F.max(f"_m_{n}").over(c_whole).alias(f"_cm_{n}") for n in maxes],
    )
    joined = local.join(carried, keys, "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), zero)

    return joined.select(
        *[c for c in df.columns],
        *[plus(f"_s_{n}", f"_cs_{n}").alias(n) for n in sums],
        *[plus(f"_p_{n}", f"_cp_{n}").alias(n) for n in peers],
        *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in lasts],
        *[F.coalesce(f"_n_{n}", f"_cn_{n}").alias(n) for n in nexts],
        *[F.coalesce(f"_ct_{n}", f"_t_{n}").alias(n) for n in totals],
        *[F.coalesce(f"_cm_{n}", f"_m_{n}").alias(n) for n in maxes],
    )


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as 0)."""
    return F.when(condition, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def widen(df: DataFrame, low: str, high: str, out: str, block: int = 10_000) -> DataFrame:
    """One row per integer in [low, high], unrolled in two bounded steps.

    The first step makes one row per block, so no row ever holds an array longer than ``block``.
    """
    first = F.floor(F.col(low) / block)
    last = F.floor(F.col(high) / block)
    blocks = (
        df.where(F.col(low) <= F.col(high))
        .withColumn("_hop", F.explode(F.sequence(first, last)))
    )
    start = F.greatest(F.col(low), F.col("_hop") * block)
    stop = F.least(F.col(high), F.col("_hop") * block + (block - 1))
    return blocks.withColumn(out, F.explode(F.sequence(start, stop))).drop("_hop")
