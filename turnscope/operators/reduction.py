"""Lossless reduction of redundant snapshots.

Captures of one session are byte prefixes of a growing file, interrupted by compactions. Each
epoch keeps one base; every other capture becomes a length into it, proven by SHA-256.

Captures: sid, count, event, captured_us, content (NULL = file missing).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.plans.ordered import flag, scan, with_chunks
from turnscope.sources.snapshots import file_digests

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NATIVE_WORK_BYTES = 1 << 26
BLOCK_BYTES = 1 << 20
LINES_AT_ONCE = 4096
# capture numbers are ordered as 16-digit text; hot sessions are cut every 10^4, 10^3 or 10^2
NUMBER_WIDTHS = (12, 13, 14)


def sha256(c: Column | str) -> Column:
    return F.sha2(c, 256)


def newlines(c: Column) -> Column:
    """Line feeds in binary content."""
    text = F.decode(c, "ISO-8859-1")
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(c: Column) -> Column:
    """Lines of a whole file: line feeds plus an unterminated tail."""
    text = F.decode(c, "ISO-8859-1")
    return newlines(c) + flag((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")))


def listing(captures: DataFrame) -> DataFrame:
    """Captures without their content: sid, count, event, captured_us, exists, bytes, sha256."""
    return captures.select(
        "sid", "count", "event", "captured_us",
        F.col("content").isNotNull().alias("exists"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"),
        sha256("content").alias("sha256"),
        line_count(F.col("content")).alias("lines"),
    )


def capture_catalog(event_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Event rows joined with snapshot files on (sid, count); the file's own size wins.

    event_rows: sid, count, event, captured_us, snapshot, snapshot_bytes; files: sid, count, length.
    Spark's file sources skip files of length zero, so a capture recorded with zero bytes and no
    file row is an empty file, not a missing one.
    """
    return event_rows.join(files, ["sid", "count"], "full").select(
        "sid", "count", "event", "captured_us",
        F.coalesce("snapshot", F.concat("sid", F.lit("."), F.col("count").cast("string"), F.lit(".transcript.jsonl"))).alias("snapshot"),
        F.coalesce("length", F.lit(0)).cast("long").alias("bytes"),
        (F.col("length").isNotNull() | F.coalesce(F.col("snapshot_bytes") == 0, F.lit(False))).alias("exists"),
    )


def numbered(captures: DataFrame) -> DataFrame:
    ordered = captures.withColumn("at", F.lpad(F.col("count").cast("string"), 16, "0"))
    return with_chunks(ordered, "sid", "at", NUMBER_WIDTHS)


def epoch_plan(captures: DataFrame) -> DataFrame:
    """Add epoch, in_flight and is_base: two ordered scans stand in for the automaton.

    A region is open after a PreCompact until the next PostCompact. The PreCompact that opens it
    ends its epoch; everything inside, the closing PostCompact included, belongs to none.
    """
    pre, post = F.col("event") == "PreCompact", F.col("event") == "PostCompact"
    seen = scan(
        numbered(captures), ["sid"], ["at"],
        lasts={"_edge": F.when(pre | post, F.col("event"))},
    ).withColumn("in_flight", F.coalesce(F.col("_edge") == "PreCompact", F.lit(False)))
    closing = F.col("in_flight") & post
    counted = scan(seen, ["sid"], ["at"], sums={"_epoch": flag(closing)})
    return counted.select(
        *captures.columns,
        F.when(~F.col("in_flight"), F.col("_epoch")).alias("epoch"),
        "in_flight",
        F.coalesce(pre & ~F.col("in_flight"), F.lit(False)).alias("is_base"),
    )


def epoch_bases(plan: DataFrame) -> DataFrame:
    """The largest non-empty snapshot of each epoch; the earliest wins ties."""
    best = F.max_by(F.struct("count", "bytes"), F.struct(F.col("bytes"), -F.col("count")))
    return (
        plan.where("epoch IS NOT NULL AND exists AND bytes > 0")
        .groupBy("sid", "epoch").agg(best.alias("b"))
        .select("sid", "epoch", F.col("b.count").alias("base_count"), F.col("b.bytes").alias("base_bytes"))
    )


def base_contents(bases: DataFrame, captures: DataFrame) -> DataFrame:
    contents = captures.select("sid", F.col("count").alias("base_count"), F.col("content").alias("base"))
    return bases.join(contents, ["sid", "base_count"])


def running_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (sid, epoch, at, block first): one running digest per base over its blocks in order.

    Only the block at hand is kept, so a base may be of any size and every byte is hashed once, however many offsets
    there are. A base with a gap between its blocks has no digest behind the gap.
    """
    base, block, start, digest, done, lines = None, b"", 0, hashlib.sha256(), 0, 0

    def advance(end: int) -> None:
        nonlocal done, lines
        part = memoryview(block)[done - start:end - start]
        digest.update(part)
        lines += bytes(part).count(b"\n")
        done += len(part)

    for batch in batches:
        rows = []
        for sid, epoch, at, body in zip(batch["sid"], batch["epoch"], batch["at"], batch["block"], strict=True):
            if (sid, epoch) != base:
                base, block, start, digest, done, lines = (sid, epoch), b"", 0, hashlib.sha256(), 0, 0
            if body is not None:
                advance(start + len(block))
                if at == done:
                    block, start = body, at
                continue
            advance(at)
            if done == at:
                rows.append((sid, epoch, at, digest.copy().hexdigest(), lines))
        yield pd.DataFrame(rows, columns=["sid", "epoch", "bytes", "prefix_sha", "prefix_lines"])


def content_blocks(rows: DataFrame, content: str, size: int = BLOCK_BYTES) -> DataFrame:
    """The rows with ``content`` cut into blocks: ``at`` and ``block`` instead of it."""
    nth = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(content) - 1, F.lit(0)) / size).cast("int"))
    return rows.select("*", F.explode(nth).alias("_i")).select(
        *[c for c in rows.columns if c != content], (F.col("_i") * F.lit(size).cast("long")).alias("at"),
        F.substring(F.col(content), F.col("_i") * size + 1, F.lit(size)).alias("block"))


def block_digests(blocks: DataFrame, offsets: DataFrame) -> DataFrame:
    """SHA-256 and line feeds of prefixes: blocks (sid, epoch, at, block), offsets (sid, epoch, bytes).

    Blocks and offsets meet sorted in one stream per base, since a digest is sequential.
    """
    wanted = offsets.select("sid", "epoch", F.col("bytes").alias("at")).distinct()
    rows = blocks.select("sid", "epoch", "at", "block").unionByName(wanted.withColumn("block", F.lit(None).cast("binary")))
    asks = F.col("block").isNull()
    # an offset at which a block begins needs only the blocks before it
    together = rows.repartition("sid", "epoch").sortWithinPartitions("sid", "epoch", "at", asks.desc())
    return together.mapInPandas(running_digests, DIGESTS)


DIGESTS = "sid string, epoch bigint, bytes bigint, prefix_sha string, prefix_lines bigint"


def prefix_digests(bases: DataFrame, offsets: DataFrame, native_bytes: int = NATIVE_WORK_BYTES) -> DataFrame:
    """SHA-256 and line feeds of base prefixes.

    bases: sid, epoch, base, base_bytes; offsets: sid, epoch, bytes. Where hashing every prefix on
    its own is cheap (offsets x base bytes), ``sha2`` on a slice does it. Otherwise one running digest passes over the
    base's blocks once. Bases in files: ``sources.snapshots.file_digests``.
    """
    wanted = offsets.select("sid", "epoch", "bytes").distinct()
    counts = wanted.groupBy("sid", "epoch").agg(F.count("*").alias("_n"))
    sized = bases.select("sid", "epoch", "base", "base_bytes").join(counts, ["sid", "epoch"])
    cheap = F.col("_n") * F.col("base_bytes") <= native_bytes
    prefix = F.substring(F.col("base"), F.lit(1), F.col("bytes").cast("int"))
    small = sized.where(cheap).join(wanted, ["sid", "epoch"]).where("bytes <= base_bytes").select(
        "sid", "epoch", "bytes", sha256(prefix).alias("prefix_sha"),
        newlines(prefix).cast("long").alias("prefix_lines"),
    )
    large = sized.where(~cheap)
    due = wanted.join(large.select("sid", "epoch", "base_bytes"), ["sid", "epoch"]).where("bytes <= base_bytes")
    large = block_digests(content_blocks(large.select("sid", "epoch", "base"), "base"), due)
    return small.unionByName(large)


def reduction_index(captures: DataFrame, native_bytes: int = NATIVE_WORK_BYTES) -> DataFrame:
    """One row per capture: where its bytes are kept and the digest that proves it."""
    plan = epoch_plan(listing(captures))
    bases = epoch_bases(plan)
    digests = prefix_digests(base_contents(bases, captures), provable(plan), native_bytes)
    return index_rows(plan, bases, digests)


def reduction_index_of_files(listed: DataFrame) -> DataFrame:
    """The same index of captures in files of any size (``snapshots.file_listing``): no content becomes a value."""
    plan = epoch_plan(listed)
    bases = epoch_bases(plan)
    paths = listed.select("sid", F.col("count").alias("base_count"), "path")
    asked = bases.join(paths, ["sid", "base_count"]).join(
        provable(plan).select("sid", "epoch", "bytes").distinct(), ["sid", "epoch"]).where("bytes <= base_bytes")
    read = file_digests(asked).select(
        "path", "bytes", F.col("sha256").alias("prefix_sha"), F.col("newlines").alias("prefix_lines"))
    digests = asked.join(read, ["path", "bytes"]).select("sid", "epoch", "bytes", "prefix_sha", "prefix_lines")
    return index_rows(plan.drop("path"), bases, digests)


def provable(plan: DataFrame) -> DataFrame:
    """Captures that a base may cover."""
    return plan.where("epoch IS NOT NULL AND exists AND bytes > 0")


def index_rows(plan: DataFrame, bases: DataFrame, digests: DataFrame) -> DataFrame:
    """Captures of a plan, settled by the digests of their base's prefixes."""
    rows = plan.join(bases, ["sid", "epoch"], "left").join(digests, ["sid", "epoch", "bytes"], "left")
    proven = F.coalesce(F.col("prefix_sha") == F.col("sha256"), F.lit(False))
    source = (
        F.when(~F.col("exists"), "missing").when(F.col("bytes") == 0, "empty")
        .when(F.col("in_flight"), "inflight").when(proven, "epoch").otherwise("full")
    )
    compacting = F.col("event").isin("PreCompact", "PostCompact")
    return rows.select(
        "sid", "count", "event", "captured_us", "bytes", "epoch", "in_flight", "is_base",
        source.alias("source"),
        F.when(F.col("exists"), F.col("sha256")).alias("sha256"),
        F.when(source == "epoch", F.col("prefix_lines")).when(F.col("exists"), F.col("lines")).alias("lines"),
        F.col("lines").alias("file_lines"), (source == "full").alias("prefix_mismatch"),
        F.coalesce(compacting, F.lit(False)).alias("compaction"),
        F.when(source == "epoch", F.col("base_count")).alias("base_count"),
    )


def extend_index(index: DataFrame, store: DataFrame, added: DataFrame, native_bytes: int = NATIVE_WORK_BYTES) -> DataFrame:
    """The index after more captures came, equal to a new one of all captures; only ``added`` ones are read.

    Epochs follow from the captures' events, which the index keeps, so the scan is resumed from its rows. What was
    proven against a base stays so while the epoch keeps that base. An epoch that got a larger base has all its
    captures proven again, by their digests in the index against prefixes of the new base; a new capture of an epoch
    that keeps its base is proven against the stored one.
    """
    older = index.join(added.select("sid", "count"), ["sid", "count"], "left_anti")  # a missing file may have come
    before = older.select("sid", "count", "event", "captured_us", (F.col("source") != "missing").alias("exists"), "bytes",
                          "sha256", F.col("file_lines").alias("lines"), F.lit(False).alias("new"))
    plan = epoch_plan(before.unionByName(listing(added).withColumn("new", F.lit(True))))
    bases, old_bases = epoch_bases(plan), epoch_bases(index.withColumn("exists", F.col("source") != "missing"))
    same = old_bases.select("sid", "epoch", "base_count", F.lit(True).alias("kept"))
    settled = bases.join(same, ["sid", "epoch", "base_count"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    due = provable(plan).join(settled.select("sid", "epoch", "kept"), ["sid", "epoch"]).where("new OR NOT kept")
    stored = store.where("kind = 'base'").select("sid", F.col("count").alias("base_count"), F.col("content").alias("base"))
    fresh = added.select("sid", F.col("count").alias("base_count"), F.col("content").alias("base"))
    contents = settled.where("kept").join(stored, ["sid", "base_count"]).unionByName(
        settled.where("NOT kept").join(fresh, ["sid", "base_count"])).drop("kept")
    digests = prefix_digests(contents, due, native_bytes)
    known = older.where("source = 'epoch'").join(
        settled.where("kept").select("sid", "epoch"), ["sid", "epoch"]).select(
        "sid", "epoch", "bytes", F.col("sha256").alias("prefix_sha"), F.col("lines").alias("prefix_lines"))
    return index_rows(plan.drop("new"), bases, digests.unionByName(known).distinct())


def payload_facts(index: DataFrame, payloads: DataFrame) -> DataFrame:
    """Compaction facts only the event payload carries (sid, count, payload JSON text)."""
    p = F.col("payload")
    summary = F.get_json_object(p, "$.compact_summary")
    instructions = F.get_json_object(p, "$.custom_instructions")
    return index.where("compaction").join(payloads, ["sid", "count"], "left").select(
        "sid", "count", "event",
        F.get_json_object(p, "$.trigger").alias("compact_trigger"),
        F.coalesce(F.length(instructions) > 0, F.lit(False)).alias("has_custom_instructions"),
        F.nullif(F.length(summary), F.lit(0)).alias("compact_summary_chars"),
    )


def reduced_store(index: DataFrame, captures: DataFrame) -> DataFrame:
    """What is kept: every epoch's base once, and full copies of whatever no base covers."""
    content = captures.select("sid", "count", "content")
    base_keys = index.where("source = 'epoch'").select(
        "sid", "epoch", F.col("base_count").alias("count"), F.lit("base").alias("kind")).distinct()
    full_keys = index.where("source IN ('inflight', 'full')").select(
        "sid", "epoch", "count", F.col("source").alias("kind"))
    return base_keys.unionByName(full_keys).join(content, ["sid", "count"])


def reconstruct_capture(index: DataFrame, store: DataFrame) -> DataFrame:
    """Every stored capture's bytes, from the reduced store alone."""
    bases = store.where("kind = 'base'").select("sid", "epoch", F.col("content").alias("base"))
    copies = store.where("kind <> 'base'").select("sid", "count", "content")
    from_base = index.where("source = 'epoch'").join(bases, ["sid", "epoch"], "left").select(
        "sid", "count", "source", "sha256", "bytes",
        F.when(
            F.octet_length("base") >= F.col("bytes"),
            F.substring(F.col("base"), F.lit(1), F.col("bytes").cast("int")),
        ).alias("content"),
    )
    whole = index.where("source IN ('inflight', 'full')").join(copies, ["sid", "count"], "left").select(
        "sid", "count", "source", "sha256", "bytes", "content")
    nothing = index.where("source = 'empty'").select(
        "sid", "count", "source", "sha256", "bytes", F.lit("").cast("binary").alias("content"))
    return from_base.unionByName(whole).unionByName(nothing)


def verify_roundtrip(index: DataFrame, store: DataFrame, native_bytes: int = NATIVE_WORK_BYTES) -> DataFrame:
    """Checks per capture using only the reduced output: (sid, count, source, failure).

    Prefixes are re-hashed base by base, so no base is copied once per capture.
    """
    stored = index.where("source = 'epoch'")
    bases = store.where("kind = 'base'").select(
        "sid", "epoch", F.col("content").alias("base"), F.octet_length("content").cast("long").alias("base_bytes"))
    digests = prefix_digests(bases, stored, native_bytes)
    prefixes = stored.join(digests, ["sid", "epoch", "bytes"], "left").select(
        "sid", "count", "source",
        F.when(F.col("prefix_sha").isNull(), "offset-past-end")
        .when(~F.col("prefix_sha").eqNullSafe(F.col("sha256")), "prefix-hash-mismatch").alias("failure"),
    )
    copies = store.where("kind <> 'base'").select("sid", "count", sha256("content").alias("_got"))
    whole = index.where("source IN ('inflight', 'full')").join(copies, ["sid", "count"], "left").select(
        "sid", "count", "source",
        F.when(~F.col("_got").eqNullSafe(F.col("sha256")), "hash-mismatch").alias("failure"))
    rest = index.where("source NOT IN ('epoch', 'inflight', 'full', 'missing')").select(
        "sid", "count", "source",
        F.when(F.col("source") != "empty", "unknown-source")
        .when(~F.col("sha256").eqNullSafe(F.lit(EMPTY_SHA)), "hash-mismatch").alias("failure"))
    return prefixes.unionByName(whole).unionByName(rest)


def verify_against_source(index: DataFrame, captures: DataFrame) -> DataFrame:
    """Re-hash originals that still exist: (sid, count, matches)."""
    live = captures.where("content IS NOT NULL").select("sid", "count", sha256("content").alias("_now"))
    return index.where("source <> 'missing'").join(live, ["sid", "count"]).select(
        "sid", "count", F.col("_now").eqNullSafe(F.col("sha256")).alias("matches"))


def staleness(index: DataFrame, files: DataFrame, copies: DataFrame, sources: DataFrame) -> DataFrame:
    """Per session: captures not yet indexed, and how its event copy relates to the source.

    files: sid, count; copies / sources: sid, content (bytes of the event log). A copy that is a
    strict prefix is behind; one that differs inside is damaged.
    """
    extra = files.join(index.select("sid", "count"), ["sid", "count"], "left_anti").groupBy("sid").agg(
        F.count("*").alias("unindexed"))
    mine = copies.select("sid", F.col("content").alias("mine"))
    theirs = sources.select("sid", F.col("content").alias("theirs"))
    n = F.octet_length("mine")
    same = sha256("mine") == sha256("theirs")
    prefix = sha256(F.substring(F.col("theirs"), F.lit(1), n)) == sha256("mine")
    logs = theirs.join(mine, "sid", "full").select(
        "sid",
        F.when(F.col("mine").isNull(), "not-copied").when(F.col("theirs").isNull() | same, "same")
        .when((n < F.octet_length("theirs")) & prefix, "behind").otherwise("diverges").alias("events_copy"),
    )
    sessions = index.select("sid").distinct()
    return sessions.join(extra, "sid", "left").join(logs, "sid", "left").select(
        "sid", F.coalesce("unindexed", F.lit(0).cast("long")).alias("unindexed"), "events_copy",
        ((F.coalesce("unindexed", F.lit(0)) > 0) | (F.col("events_copy") == "behind")).alias("stale"),
        F.col("events_copy").isin("diverges", "not-copied").alias("failed"),
    )


def prune_eligible(checks: DataFrame, against: DataFrame, stale: DataFrame) -> DataFrame:
    """Sessions whose snapshots may go: nothing failed, nothing behind. Deleting is the user's act."""
    failed = checks.where("failure IS NOT NULL").select("sid").unionByName(
        against.where("NOT matches").select("sid"))
    blocked = failed.unionByName(stale.where("stale OR failed").select("sid")).distinct()
    return stale.select("sid").join(blocked, "sid", "left_anti")


def reduction_stats(index: DataFrame) -> DataFrame:
    """Captures per source and bytes before and after, per session and overall (sid NULL)."""
    base = F.when((F.col("source") == "epoch") & (F.col("count") == F.col("base_count")), F.col("bytes"))
    copy = F.when(F.col("source").isin("inflight", "full"), F.col("bytes"))
    counts = [F.count_if(F.col("source") == s).alias(s) for s in ("epoch", "inflight", "full", "empty", "missing")]
    zero = F.lit(0).cast("long")
    grouped = index.rollup("sid").agg(
        F.count("*").alias("captures"), *counts,
        F.sum("bytes").alias("orig_bytes"),
        F.coalesce(F.sum(base), zero).alias("base_bytes"),
        F.coalesce(F.sum(copy), zero).alias("full_bytes"),
    )
    kept = F.col("base_bytes") + F.col("full_bytes")
    return grouped.withColumn("ratio", F.try_divide(F.col("orig_bytes"), kept))


def compaction_annotations(index: DataFrame, store: DataFrame) -> DataFrame:
    """Compaction records found in the base of each session's last epoch, with how many of the
    preserved ids resolve to a line of that base."""
    last = index.where("epoch IS NOT NULL AND base_count IS NOT NULL").groupBy("sid").agg(F.max("epoch").alias("epoch"))
    bases = store.where("kind = 'base'").join(last, ["sid", "epoch"])
    return annotations_of_lines(content_lines(bases, "sid", "epoch"))


def annotations_of_lines(lines: DataFrame) -> DataFrame:
    """Compaction records among lines (sid, epoch, line_no, line) of one base per session."""
    text = F.decode("line", "UTF-8")
    parsed = lines.select("sid", "epoch", F.col("line_no").cast("int").alias("line_index"), F.try_parse_json(text).alias("v"))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("v", path, kind)

    rows = parsed.select(
        "sid", "epoch", "line_index", field("$.uuid", "string").alias("uuid"), field("$.type", "string").alias("type"),
        field("$.compactMetadata", "map<string,variant>").alias("meta"),
        field("$.compactMetadata.preTokens", "bigint").alias("pre_tokens"),
        field("$.compactMetadata.postTokens", "bigint").alias("post_tokens"),
        field("$.compactMetadata.cumulativeDroppedTokens", "bigint").alias("dropped_tokens"),
        field("$.compactMetadata.durationMs", "bigint").alias("duration_ms"),
        field("$.compactMetadata.preservedMessages.allUuids", "array<string>").alias("uuids"),
    )
    present = rows.where("uuid IS NOT NULL").select("sid", F.col("uuid").alias("u")).distinct().withColumn("_hit", F.lit(True))
    found = rows.where("size(map_keys(meta)) > 0").drop("uuid", "meta")
    keys = [c for c in found.columns if c != "uuids"]
    asked = found.select(*keys, F.explode_outer("uuids").alias("u"))
    return asked.join(present, ["sid", "u"], "left").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("u")), ",").alias("preserved"),
        F.count("_hit").alias("resolved"),
        F.count_if(F.col("u").isNotNull() & F.col("_hit").isNull()).alias("unresolved"),
    )


def content_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """Lines of ``content`` with their ends: keys, line_no, at (byte), line. One row's lines come in bounded batches."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                content, at, found = row[-1] or b"", 0, []
                number = 0
                while at < len(content):
                    end = content.find(b"\n", at) + 1 or len(content)
                    found.append((*row[:-1], number, at, content[at:end]))
                    at, number = end, number + 1
                    if len(found) == LINES_AT_ONCE:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=names)

    kept = rows.select(*keys, "content")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    names = [*keys, "line_no", "at", "line"]
    return kept.mapInPandas(cut, f"{types}, line_no bigint, at bigint, line binary")


def corpus_stats(files: DataFrame) -> DataFrame:
    """Sessions, snapshots and bytes of a file listing (path, length)."""
    name = F.element_at(F.split("path", "/"), -1)
    is_events = F.endswith(name, F.lit(".events.jsonl"))
    return files.agg(
        F.countDistinct(F.when(is_events, F.substring_index(name, ".", 1))).alias("sessions"),
        F.count_if(F.endswith(name, F.lit(".transcript.jsonl"))).alias("snapshots"),
        F.sum("length").alias("bytes"),
    )


def session_of(path: str) -> Column:
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def retention_by_age(files: DataFrame, cutoff_us: int) -> DataFrame:
    return files.where(F.col("modified_us") < cutoff_us)


def retention_keep_n(files: DataFrame, keep: int, cutoff_us: int | None = None) -> DataFrame:
    """Files outside the ``keep`` most recently active sessions, plus those older than the cutoff."""
    named = files.withColumn("sid", session_of("path"))
    kept = (
        named.groupBy("sid").agg(F.max("modified_us").alias("m"))
        .orderBy(F.desc("m"), "sid").limit(keep).select("sid")
    )
    out = named.join(kept, "sid", "left_anti").select(*files.columns)
    if cutoff_us is None:
        return out
    return out.unionByName(retention_by_age(files, cutoff_us)).distinct()


def capture_deltas(captures: DataFrame) -> DataFrame:
    """Growth between captures at three scales: turn, compaction and session.

    turn: Stop to the next Stop; compaction: PreCompact to the next PostCompact; session: the
    latest SessionStart to the SessionEnd, or to the last capture when none ended it.
    """
    rows = numbered(listing(captures))
    here = F.struct("count", "bytes", "lines", "captured_us")
    stop, pre = F.col("event") == "Stop", F.col("event") == "PreCompact"
    post, start = F.col("event") == "PostCompact", F.col("event") == "SessionStart"
    seen = scan(
        rows, ["sid"], ["at"],
        lasts={
            "_stop": F.when(stop, here), "_start": F.when(start, here),
            "_edge": F.when(pre | post, F.struct(F.col("event"), here.alias("at"))),
        },
        nexts={"_more": F.col("count")},
    )
    is_end = (F.col("event") == "SessionEnd") | F.col("_more").isNull()
    sources = F.array_compact(F.array(
        F.when(stop & F.col("_stop").isNotNull(), F.struct(F.lit("turn").alias("scale"), F.col("_stop").alias("a"))),
        F.when(
            post & (F.col("_edge.event") == "PreCompact"),
            F.struct(F.lit("compaction").alias("scale"), F.col("_edge.at").alias("a")),
        ),
        F.when(is_end & F.col("_start").isNotNull(), F.struct(F.lit("session").alias("scale"), F.col("_start").alias("a"))),
    ))
    return seen.select("*", F.explode(sources).alias("d")).select(
        "sid", "d.scale", F.col("d.a.count").alias("from_count"), F.col("count").alias("to_count"),
        (F.col("bytes") - F.col("d.a.bytes")).alias("bytes_delta"),
        (F.col("lines") - F.col("d.a.lines")).alias("lines_delta"),
        ((F.col("captured_us") - F.col("d.a.captured_us")) / 1e6).alias("seconds"),
    )
