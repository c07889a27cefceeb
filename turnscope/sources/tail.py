"""A streaming source over growing log files: a position is a map from file to byte.

Spark's own file source takes each file once, so lines appended to a known file would be lost. This one looks at sizes
at every trigger and reads complete lines behind the last position only; a line without its end waits. A file that
became shorter, or whose beginning is another one, is read from zero. The checkpoint holds the map, so a restarted
query goes on where it stopped. A large range is cut into parts that are read by different tasks.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
HEAD_BYTES = 256
LINES = 4096
SCHEMA = "path string, at bigint, line string"


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end); ``origin`` is where the first of them may begin."""

    path: str
    origin: int
    start: int
    end: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def log_files(files: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    for info in files.get_file_info(fs.FileSelector(folder, recursive=True)):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            yield info


def complete_bytes(source: pa.NativeFile, size: int) -> int:
    """Where the last complete line of the first ``size`` bytes ends."""
    end = size
    while end:
        begin = max(0, end - READ_BYTES)
        source.seek(begin)
        newline = source.read(end - begin).rfind(b"\n")
        if newline >= 0:
            return begin + newline + 1
        end = begin
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.known: dict[str, tuple] = {}  # size and time of files that did not change since they were looked at

    def initialOffset(self) -> dict:
        return {}

    def position(self, files: fs.FileSystem, info: fs.FileInfo) -> dict:
        """How many bytes are complete lines, and a mark of the beginning, by which a replaced file is told."""
        seen = (info.size, info.mtime_ns)
        if self.known.get(info.path, (None,))[0] != seen:
            with files.open_input_file(info.path) as source:
                done = complete_bytes(source, info.size)
                source.seek(0)
                head = source.read(min(done, HEAD_BYTES)).split(b"\n")[0] if done else b""
            self.known[info.path] = seen, {"bytes": done, "head": zlib.crc32(head)}
        return self.known[info.path][1]

    def latestOffset(self) -> dict:
        files, folder = located(self.folder)
        return {info.path: self.position(files, info) for info in log_files(files, folder)}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        ranges = []
        for path, now in sorted(end.items()):
            was = start.get(path, {"bytes": 0})
            goes_on = was["bytes"] and was["head"] == now["head"] and was["bytes"] <= now["bytes"]
            origin = was["bytes"] if goes_on else 0
            ranges += [Range(path, origin, at, min(at + self.range_bytes, now["bytes"]))
                       for at in range(origin, now["bytes"], self.range_bytes)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.folder)
        with files.open_input_file(partition.path) as opened:
            source = io.BufferedReader(opened, READ_BYTES)
            at = partition.start
            if at > partition.origin:  # a line begun before belongs to the range before
                source.seek(at - 1)
                at += len(source.readline()) - 1
            else:
                source.seek(at)
            lines: list[tuple[int, str]] = []
            while at < partition.end and (line := source.readline()):
                lines.append((at, line.rstrip(b"\n").decode("utf-8", "replace")))
                at += len(line)
                if len(lines) == LINES:
                    yield self.batch(partition.path, lines)
                    lines = []
            yield self.batch(partition.path, lines)

    @staticmethod
    def batch(path: str, lines: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(lines), pa.string()), pa.array([at for at, _ in lines], pa.int64()),
             pa.array([line for _, line in lines], pa.string())], names=["path", "at", "line"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """New complete lines below a folder as a stream: path, at (byte), line."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=folder, **options).load()
