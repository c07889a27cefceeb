"""Snapshot files of any size: blocks and lines by byte ranges, and digests of prefixes read where the files lie.

A snapshot is never one value. ``snapshot_blocks`` and ``snapshot_lines`` are read by ranges of bytes, each range a
task; ``file_digests`` passes over a file once with one running hash, in blocks, however many prefixes are asked for.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from turnscope.sources.tail import READ_BYTES, Range, located, log_files

BLOCK_BYTES = 4 << 20
RANGE_BYTES = 128 << 20


def blocks_between(source: pa.NativeFile, part: Range, size: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of a range."""
    source.seek(part.start)
    for at in range(part.start, part.end, size):
        yield at, source.read(min(size, part.end - at))


def lines_between(source: pa.NativeFile, part: Range, size: int) -> Iterator[tuple[int, bytes]]:
    """(position, line with its end) of the lines that begin in a range; the last line of a file may lack an end."""
    buffered = io.BufferedReader(source, min(size, READ_BYTES))
    at = part.start
    buffered.seek(max(0, at - 1))
    if at:  # a line begun before belongs to the range before
        at += len(buffered.readline()) - 1
    while at < part.end and (line := buffered.readline()):
        yield at, line
        at += len(line)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, pieces: Callable[[pa.NativeFile, Range, int], Iterator[tuple[int, bytes]]]):
        self.folder, self.pieces = options["path"], pieces
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.block_bytes = int(options.get("blockBytes", BLOCK_BYTES))
        self.suffix = options.get("suffix", "")

    def partitions(self) -> Sequence[Range]:
        files, folder = located(self.folder)
        return [Range(info.path, 0, at, min(at + self.range_bytes, info.size))
                for info in log_files(files, folder) if info.path.endswith(self.suffix)
                for at in range(0, info.size, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.folder)
        held, size = [], 0
        with files.open_input_file(partition.path) as source:
            for piece in self.pieces(source, partition, self.block_bytes):
                held.append(piece)
                size += len(piece[1])
                if size >= self.block_bytes:
                    yield self.batch(partition.path, held)
                    held, size = [], 0
        if held:
            yield self.batch(partition.path, held)

    @staticmethod
    def batch(path: str, pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(pieces), pa.string()), pa.array([at for at, _ in pieces], pa.int64()),
             pa.array([body for _, body in pieces], pa.binary())], names=["path", "at", "body"])


class _Ranges(DataSource):
    def schema(self) -> str:
        return "path string, at bigint, body binary"


class SnapshotBlocks(_Ranges):
    @classmethod
    def name(cls) -> str:
        return "snapshot_blocks"

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options), blocks_between)


class SnapshotLines(_Ranges):
    @classmethod
    def name(cls) -> str:
        return "snapshot_lines"

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options), lines_between)


def _load(spark: SparkSession, source: type[_Ranges], folder: str, options: dict[str, str]) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=folder, suffix=".transcript.jsonl", **options).load()


def snapshot_blocks(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """path, at, body: blocks of at most ``blockBytes`` of every snapshot below a folder."""
    return _load(spark, SnapshotBlocks, folder, options)


def snapshot_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """path, at, body: lines, with their ends, of every snapshot below a folder."""
    return _load(spark, SnapshotLines, folder, options)


DIGESTS = "path string, bytes bigint, sha256 string, newlines bigint, torn boolean"


def _read_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (path, bytes): every file is read once, in blocks, up to its largest prefix."""
    path, source, digest, done, lines, last = None, None, None, 0, 0, b""
    for batch in batches:
        out = []
        for name, end in zip(batch["path"], batch["bytes"]):
            if name != path:
                if source:
                    source.close()
                files, place = located(name)
                path, source, digest, done, lines, last = name, files.open_input_file(place), hashlib.sha256(), 0, 0, b""
            while done < end and (block := source.read(min(BLOCK_BYTES, end - done))):
                digest.update(block)
                lines += block.count(b"\n")
                done, last = done + len(block), block[-1:]
            if done == end:  # a prefix longer than the file has no digest
                out.append((name, end, digest.copy().hexdigest(), lines, done > 0 and last != b"\n"))
        yield pd.DataFrame(out, columns=["path", "bytes", "sha256", "newlines", "torn"])
    if source:
        source.close()


def file_digests(prefixes: DataFrame) -> DataFrame:
    """SHA-256, line feeds and whether a line is unfinished, of prefixes (path, bytes) of files.

    Only names and lengths are shuffled; a hash is sequential, so a file is one task's work and no other file's.
    """
    asked = prefixes.select("path", "bytes").distinct()
    return asked.repartition("path").sortWithinPartitions("path", "bytes").mapInPandas(_read_digests, DIGESTS)


def file_listing(events: DataFrame, files: DataFrame) -> DataFrame:
    """The listing of captures in files: events (sid, count, event, captured_us) and files (sid, count, path, length).

    Adds exists, bytes, sha256, lines and path; every file is hashed where it lies.
    """
    whole = file_digests(files.select("path", F.col("length").alias("bytes"))).select(
        "path", "sha256", (F.col("newlines") + F.col("torn").cast("long")).alias("lines"))
    known = files.join(whole, "path", "left")
    return events.join(known, ["sid", "count"], "left").select(
        "sid", "count", "event", "captured_us", F.col("path").isNotNull().alias("exists"),
        F.coalesce("length", F.lit(0)).cast("long").alias("bytes"), "sha256", F.col("lines").cast("long").alias("lines"), "path")
