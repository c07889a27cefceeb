"""The reduced store at the grain of lines: every line once, and captures as runs of lines.

Three tables. ``bodies`` holds each different line under its content address. ``sequences`` lists the lines of every
base in order, with the byte at which each begins. ``runs`` says of each capture which lines of which base follow one
another in it, from which byte on; a capture that a base covers is one run, cut at its length. Lines of a capture that
no base has are listed in ``own``. Positions are sums of lengths, so a capture is rebuilt as rows (at, line) that
need no common task; its digest is taken over them in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.operators.reduction import block_digests, content_lines, reduced_store
from turnscope.plans.ordered import flag, scan, widen, with_chunks
from turnscope.session import materialize

LINE_WIDTHS = (12, 13, 14)  # of a line number in 16 digits: hot captures are cut every 10^4, 10^3 or 10^2 lines


@dataclass(frozen=True)
class LineStore:
    bodies: DataFrame  # address, line
    sequences: DataFrame  # sid, epoch, line_no, at, address
    runs: DataFrame  # sid, count, run, epoch, first, last (lines of the base), at, bytes
    own: DataFrame  # sid, count, at, address


def addressed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"address": F.sha2("line", 256), "size": F.octet_length("line").cast("long")})


def line_store(index: DataFrame, lines: DataFrame) -> LineStore:
    """From an index and the lines of its stored contents (sid, epoch, count, kind, line_no, at, line).

    A copied line is looked up in the bases of its session, at its first place there. Neighbours in a copy that are
    neighbours in the base form a run.
    """
    stored = addressed(lines)
    bodies = stored.groupBy("address").agg(F.any_value("line").alias("line"))
    sequences = stored.where("kind = 'base'").select("sid", "epoch", "line_no", "at", "address")
    first = sequences.groupBy("sid", "address").agg(F.min(F.struct("epoch", "line_no")).alias("there"))
    copied = stored.where("kind <> 'base'").drop("epoch", "line", "kind").join(first, ["sid", "address"], "left")
    found = copied.where("there IS NOT NULL").select(
        "sid", "count", "line_no", "at", "size", "there.epoch", F.col("there.line_no").alias("base_line"),
        F.concat_ws("#", "sid", "count").alias("copy"), F.lpad(F.col("line_no").cast("string"), 16, "0").alias("place"))
    before = scan(with_chunks(found, "copy", "place", LINE_WIDTHS), ["copy"], ["place"],
                  lasts={"_before": F.struct("line_no", "epoch", "base_line")})
    goes_on = F.struct(F.col("line_no") - 1, "epoch", F.col("base_line") - 1) == F.struct(
        "_before.line_no", "_before.epoch", "_before.base_line")
    numbered = scan(before.withColumn("_starts", flag(~F.coalesce(goes_on, F.lit(False)))), ["copy"], ["place"],
                    sums={"_run": F.col("_starts")})
    runs = numbered.groupBy("sid", "count", (F.col("_run") + F.col("_starts")).alias("run")).agg(
        F.min("epoch").alias("epoch"), F.min("base_line").alias("first"), F.max("base_line").alias("last"),
        F.min("at").alias("at"), F.sum("size").alias("bytes"))
    covered = index.where("source = 'epoch'").select(
        "sid", "count", F.lit(1).cast("long").alias("run"), "epoch", F.lit(0).cast("long").alias("first"),
        F.col("lines").alias("last"), F.lit(0).cast("long").alias("at"), "bytes")
    own = copied.where("there IS NULL").select("sid", "count", "at", "address")
    return LineStore(bodies, sequences, covered.unionByName(runs), own)


def of_captures(index: DataFrame, captures: DataFrame) -> LineStore:
    contents = reduced_store(index, captures)
    return line_store(index, materialize(content_lines(contents, "sid", "epoch", "count", "kind"), "lines"))


def rebuilt_lines(store: LineStore) -> DataFrame:
    """sid, count, at, line of every capture in the store; the last line of a covered one is cut at its length."""
    begin = store.sequences.select("sid", "epoch", F.col("line_no").alias("first"), F.col("at").alias("base_at"))
    spread = widen(store.runs.join(begin, ["sid", "epoch", "first"]), "first", "last", "line_no")
    theirs = spread.withColumnRenamed("at", "run_at").join(store.sequences, ["sid", "epoch", "line_no"])
    into = F.col("at") - F.col("base_at")  # how far into the run a line begins
    placed = theirs.where(into < F.col("bytes")).select(
        "sid", "count", (F.col("run_at") + into).alias("at"), "address", (F.col("bytes") - into).alias("room"))
    every = placed.unionByName(store.own.withColumn("room", F.lit(None).cast("long")))
    line = F.when(F.octet_length("line") > F.col("room"), F.substring("line", F.lit(1), F.col("room").cast("int")))
    return every.join(store.bodies, "address").select("sid", "count", "at", F.coalesce(line, "line").alias("line"))


def reconstruct_from_lines(index: DataFrame, store: LineStore) -> DataFrame:
    """sid, count, source and the digest of what the lines of each stored capture amount to."""
    held = index.where("source IN ('epoch', 'inflight', 'full', 'empty')")
    blocks = rebuilt_lines(store).select("sid", F.col("count").alias("epoch"), "at", F.col("line").alias("block"))
    digests = block_digests(blocks, held.select("sid", F.col("count").alias("epoch"), "bytes")).select(
        "sid", F.col("epoch").alias("count"), "bytes", F.col("prefix_sha").alias("sha256"))
    return held.select("sid", "count", "source", "bytes").join(digests, ["sid", "count", "bytes"], "left").drop("bytes")


def stored_bytes(index: DataFrame, store: LineStore) -> DataFrame:
    """Bytes of all captures, of the different lines kept, of the rows that order them, and the ratio."""
    before = index.agg(F.sum("bytes").alias("orig_bytes"))
    lines = store.bodies.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("line_bytes"))
    rows = store.sequences.select(F.lit(1)).unionAll(store.own.select(F.lit(1))).agg(F.count("*").alias("places"))
    runs = store.runs.agg(F.count("*").alias("runs"))
    both = before.join(F.broadcast(lines)).join(F.broadcast(rows)).join(F.broadcast(runs))
    return both.withColumn("ratio", F.try_divide(F.col("orig_bytes"), F.col("line_bytes")))
