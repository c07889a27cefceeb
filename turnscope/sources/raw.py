"""Readers for the raw log files: capture events, transcripts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions import vocab as V


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and a place that grows along the file.

    A file is split into blocks read by different tasks; block start, then row id within the task,
    is the order of lines in the file.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("place"),
    )


def variant(c: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(c, path, kind)


def capture_events(lines: DataFrame) -> DataFrame:
    """Event records; blank or broken lines and non-integer counts are dropped, first row per
    (session, count) wins. lines: line, path, place."""
    v = lines.select("path", "place", F.try_parse_json("line").alias("v")).where("v IS NOT NULL")
    count_type = F.schema_of_variant(F.variant_get("v", "$.count", "variant"))
    rows = v.where(count_type == "BIGINT").select(
        variant("v", "$.session_id", "string").alias("sid"),
        variant("v", "$.count", "bigint").alias("count"),
        variant("v", "$.event", "string").alias("event"),
        variant("v", "$.hook_event_name", "string").alias("hook_event_name"),
        variant("v", "$.captured_at", "string").alias("captured_at"),
        variant("v", "$.ts", "string").alias("ts"),
        variant("v", "$.prompt_id", "string").alias("prompt_id"),
        variant("v", "$.tool_use_id", "string").alias("tool_use_id"),
        variant("v", "$.snapshot", "string").alias("snapshot"),
        variant("v", "$.snapshot_bytes", "bigint").alias("snapshot_bytes"),
        variant("v", "$.snapshot_error", "string").alias("snapshot_error"),
        F.to_json(F.variant_get("v", "$.payload", "variant")).alias("payload"),
        "path", "place",
    )
    rest = [c for c in rows.columns if c not in ("sid", "count", "path", "place")]
    return rows.groupBy("sid", "count").agg(
        F.min_by(F.struct(*rest), F.struct("path", "place")).alias("r")
    ).select("sid", "count", "r.*")


def scan_capture_events(spark: SparkSession, path: str) -> DataFrame:
    return capture_events(text_lines(spark, path))


def scan_transcript_lines(spark: SparkSession, path: str, sid: Column | None = None) -> DataFrame:
    """Parsed transcript lines, broken ones dropped: sid, file_size, path, place, v (VARIANT).

    The session is the file name up to its first dot unless given.
    """
    name = F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1)
    return text_lines(spark, path).select(
        (name if sid is None else sid).alias("sid"), "file_size", "path", "place",
        F.try_parse_json("line").alias("v"),
    ).where("v IS NOT NULL")


def snapshot_names(files: DataFrame) -> DataFrame:
    """Session and capture number from snapshot file names; other files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("*", name.alias("snapshot")).where(F.col("snapshot").rlike(V.SNAPSHOT_NAME))
    return named.select(
        F.regexp_extract("snapshot", V.SNAPSHOT_NAME, 1).alias("sid"),
        F.regexp_extract("snapshot", V.SNAPSHOT_NAME, 2).cast("bigint").alias("count"),
        *[c for c in named.columns if c not in ("sid", "count")],
    )


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty snapshot files with content (at most 2 GB each, Spark's limit for one value)."""
    return snapshot_names(
        spark.read.format("binaryFile").option("pathGlobFilter", "*.transcript.jsonl").load(path)
    )


def discover_sessions(files: DataFrame) -> DataFrame:
    """Sessions known from event files or, failing that, from snapshot names."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = ".events.jsonl"
    by_events = files.where(F.endswith(name, F.lit(suffix))).select(
        F.expr("left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - 13)").alias("sid"))
    return by_events.unionByName(snapshot_names(files).select("sid")).distinct()


def ordered_key(v: str = "v") -> Column:
    """Identity of a transcript line: its uuid, else (timestamp, type, first 60 of content)."""
    content = F.coalesce(variant(v, "$.content", "string"), F.lit("None"))
    fallback = F.concat_ws(
        "\u0001", F.lit("k"), F.coalesce(variant(v, "$.timestamp", "string"), F.lit("")),
        F.coalesce(variant(v, "$.type", "string"), F.lit("")), F.substring(content, 1, 60),
    )
    return F.coalesce(F.nullif(variant(v, "$.uuid", "string"), F.lit("")), fallback)


def text_of(content: Column) -> Column:
    """Plain text of a string-or-array content: the string, or its text blocks joined by blanks."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
    )
    return F.when(blocks.isNotNull(), F.array_join(texts, " ")).otherwise(
        F.coalesce(F.try_variant_get(content, "$", "string"), F.lit(""))
    )
