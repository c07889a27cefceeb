"""Snapshots read by byte ranges, prefixes hashed where they lie, the line store, and the growing index."""

import hashlib
import random
import resource

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnscope.operators import linegrain, reduction
from turnscope.session import materialize
from turnscope.sources import raw, snapshots

CAPTURE = "sid string, count bigint, event string, captured_us bigint, content binary"
EVENTS = ["PreCompact", "PostCompact", "Stop", "Stop", "Stop", "SessionStart"]


def histories(rng, sessions=12):
    """Captures of files that grow, are compacted, altered, emptied or lost, with torn ends and odd bytes."""
    out = []
    for s in range(sessions):
        content = b""
        for n in range(1, rng.randint(2, 14)):
            content += b"".join(rng.choice([b"same\n", b"\xff\xfe\n", b"\n", f"line {rng.random()}\n".encode(), b"torn"])
                                for _ in range(rng.randint(0, 5)))
            if rng.random() < 0.1:
                content = content[len(content) // 2:]
            fate = rng.random()
            kept = None if fate < 0.08 else b"" if fate < 0.16 else b"~" + content if fate < 0.26 else content
            out.append((f"s{s}", n, rng.choice(EVENTS), 1000 * s + n, kept))
    return out


def index_set(index):
    return {(r.sid, r["count"], r.bytes, r.epoch, r.in_flight, r.is_base, r.source, r.sha256, r.lines, r.base_count)
            for r in index.collect()}


def test_ranges_give_back_the_bytes(spark, tmp_path):
    rng = random.Random(1)
    bodies = {f"s{i}.{i}.transcript.jsonl": bytes(rng.choice(b"ab\n\xff") for _ in range(rng.choice([0, 1, 50, 999]))) for i in range(8)}
    bodies["s9.1.transcript.jsonl"] = b"x" * 700 + b"\n" + b"y"
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "s1.events.jsonl").write_bytes(b"no snapshot")
    small = {"rangeBytes": "97", "blockBytes": "10"}
    for read in (snapshots.snapshot_blocks, snapshots.snapshot_lines):
        parts: dict = {}
        for r in read(spark, str(tmp_path), **small).collect():
            parts.setdefault(r.path.rsplit("/", 1)[1], []).append((r.at, bytes(r.body)))
        assert {n: b"".join(b for _, b in sorted(p)) for n, p in parts.items()} == {n: b for n, b in bodies.items() if b}
        for pieces in parts.values():
            if read is snapshots.snapshot_lines:
                assert all(b.endswith(b"\n") or (at, b) == max(pieces) for at, b in pieces)
                assert all(b.count(b"\n") <= 1 for _, b in pieces)


def test_three_gigabytes_with_many_prefixes_in_flat_memory(tmp_path):
    path, size = tmp_path / "big", 3 << 30
    with open(path, "wb") as f:
        f.seek(size - 3)
        f.write(b"\nz\n")
    ends = sorted({0, 1, size, size - 1, size - 3, size + 5, *range(7, size, size // 500)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    batches = (pd.DataFrame({"path": str(path), "bytes": ends[i:i + 100]}) for i in range(0, len(ends), 100))
    got = pd.concat(list(snapshots._read_digests(batches)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 * 1024
    assert got["bytes"].tolist() == [e for e in ends if e <= size]
    last = got.set_index("bytes")
    assert (last.newlines[size], last.torn[size], last.torn[size - 1], last.newlines[size - 1]) == (2, False, True, 1)
    zeros = hashlib.sha256()
    zeros.update(bytes(ends[3]))
    assert last.sha256[ends[3]] == zeros.hexdigest() and last.sha256[0] == hashlib.sha256().hexdigest()


def test_index_of_files_equals_index_of_values(spark, tmp_path):
    captures = histories(random.Random(2))
    for sid, n, _, _, content in captures:
        if content is not None:
            (tmp_path / f"{sid}.{n}.transcript.jsonl").write_bytes(content)
    table = spark.createDataFrame(captures, CAPTURE)
    names = raw.snapshot_names(spark.createDataFrame([(str(p), p.stat().st_size) for p in tmp_path.iterdir()], "path string, length long"))
    listed = snapshots.file_listing(table.drop("content"), names.select("sid", "count", "path", "length"))
    assert index_set(reduction.reduction_index_of_files(listed)) == index_set(reduction.reduction_index(table))


def test_blocks_hash_like_whole_bases(spark, monkeypatch):
    rng = random.Random(3)
    bodies = {s: bytes(rng.choice(b"ab\n") for _ in range(rng.choice([0, 1, 9, 10, 11, 100]))) for s in "abcdef"}
    rows = spark.createDataFrame([(s, 0, b) for s, b in bodies.items()], "sid string, epoch long, base binary")
    offsets = [(s, 0, n) for s, b in bodies.items() for n in {0, 1, 5, 10, 20, len(b), len(b) + 1}]
    asked = spark.createDataFrame(offsets, "sid string, epoch long, bytes long")
    got = {(r.sid, r.bytes): (r.prefix_sha, r.prefix_lines) for r in
           reduction.block_digests(reduction.content_blocks(rows, "base", 10), asked).collect()}
    assert got == {(s, n): (hashlib.sha256(bodies[s][:n]).hexdigest(), bodies[s][:n].count(b"\n"))
                   for s, _, n in offsets if n <= len(bodies[s])}


def rebuilt_exactly(spark, captures, hot_rows="1000000"):
    table = spark.createDataFrame(captures, CAPTURE)
    index = materialize(reduction.reduction_index(table), "index")
    spark.conf.set("turnscope.hotRows", hot_rows)
    store = linegrain.of_captures(index, table)
    parts: dict = {}
    for r in linegrain.rebuilt_lines(store).collect():
        parts.setdefault((r.sid, r["count"]), []).append((r.at, bytes(r.line)))
    contents = {(s, n): c for s, n, _, _, c in captures if c is not None}
    assert {k: b"".join(b for _, b in sorted(p)) for k, p in parts.items()} == {k: c for k, c in contents.items() if c}
    spark.conf.unset("turnscope.hotRows")
    digests = {(r.sid, r["count"]): r.sha256 for r in linegrain.reconstruct_from_lines(index, store).collect()}
    assert digests == {k: hashlib.sha256(c).hexdigest() for k, c in contents.items()}
    return index, store


def test_line_store_rebuilds_every_capture(spark):
    index, store = rebuilt_exactly(spark, histories(random.Random(4)))
    assert store.bodies.count() == store.bodies.select("address").distinct().count()
    assert store.runs.where("count > 0").count() and store.own.count()


def test_line_store_of_hot_captures(spark):
    rebuilt_exactly(spark, histories(random.Random(5), 5), "5")


def test_line_store_keeps_a_line_once(spark):
    body = b"".join(f"line {i}\n".encode() for i in range(2000))
    captures = [("s", n, "Stop", n, body[:n * 1000]) for n in range(1, 20)] + [("s", 20, "Stop", 20, b"~\n" + body)]
    index, store = rebuilt_exactly(spark, captures)
    row = linegrain.stored_bytes(index, store).first()
    # the altered copy is the longest and so the base; what else is kept are torn ends
    assert row.line_bytes <= len(body) + 2 + 19 * 10 and row.ratio > 5 and row.runs <= 22


@pytest.mark.parametrize("seed", [6, 7])
def test_grown_index_equals_a_new_one(spark, seed):
    rng = random.Random(seed)
    captures = histories(rng)
    table = spark.createDataFrame(captures, CAPTURE)
    whole = index_set(reduction.reduction_index(table))
    cut = {f"s{i}": rng.randint(0, 9) for i in range(12)}
    age = F.element_at(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]), F.col("sid"))
    early, late = table.where(F.col("count") <= age), table.where(F.col("count") > age)
    index = reduction.reduction_index(early).cache()
    # nothing but the store's bases and the added captures can be read: earlier contents are not given
    store = reduction.reduced_store(index, early).where("kind = 'base'")
    assert index_set(reduction.extend_index(index, store, late)) == whole
