"""Order statistics, global positions, repeated batches, and look-ups with missing keys."""

import random

import pytest
from pyspark.sql import functions as F

from turnscope.operators import oplog, trace, verdicts
from turnscope.streaming import jobs


def test_bands_of_any_doubles(spark):
    rng = random.Random(8)
    groups = {
        "one": [3.25], "equal": [7.5] * 9, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "near": [1.0 + k * 2.0 ** -52 for k in range(300)], "ends": [1.7e308, -1.7e308, 5e-324, 0.0, -0.0, -5e-324],
        **{f"g{k}": [rng.random() for _ in range(rng.randint(1, 40))] for k in range(60)}}
    rows = [(b, v) for b, vs in groups.items() for v in vs] + [("one", None), ("nothing", None), ("one", float("nan"))]
    got = {r.band: (r.n, r.median, r.p95, r.max) for r in oplog.bands(spark.createDataFrame(rows, "band string, value double")).collect()}
    expected = {}
    for band, vs in groups.items():
        s = sorted(vs)
        expected[band] = (len(s), s[len(s) // 2], s[int(len(s) * 0.95)], s[-1])
    assert got == expected


def test_bands_of_nothing(spark):
    assert oplog.bands(spark.createDataFrame([], "band string, value double")).count() == 0


@pytest.mark.parametrize("sids", [["one"], [f"prefix-{i:03d}" for i in range(90)]])
def test_global_positions(spark, sids):
    rng = random.Random(9)
    keys = [(s, i) for s in sids for i in range(1, rng.randint(2, 400 // len(sids) + 3))]
    rng.shuffle(keys)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # ranges of a small table would be merged into one
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        ranked = verdicts.global_rank(spark.createDataFrame(keys, "sid string, idx long")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [(r.sid, r.idx) for r in sorted(ranked, key=lambda r: r.pos)] == sorted(keys)
    assert [r.pos for r in sorted(ranked, key=lambda r: r.pos)] == list(range(len(keys)))


def test_repeated_batch_replaces_itself(spark, tmp_path):
    schema = "ts string, idx long"
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", 1), ("2024-01-02T00:00:00Z", 2)], schema)
    write = jobs.append_batch(str(tmp_path))
    write(rows, 0)
    write(rows, 0)
    write(rows.where("idx = 2"), 1)
    back = jobs.read_log(spark, str(tmp_path), rows.schema)
    assert sorted(r.idx for r in back.collect()) == [1, 2, 2]


def test_keys_that_are_missing(spark):
    turns = spark.createDataFrame([("k1", "s", 1, "a", ""), ("k2", "s", 2, "b", "x")], "key string, sid string, idx long, text string, previous string")
    asked = verdicts.uncached_requests(turns, spark.createDataFrame([("k1",), ("k9",)], "key string"))
    assert [r.key for r in asked.collect()] == ["k2"]
    messages = spark.createDataFrame([("s", 1, "here")], "sid string, idx long, text string")
    marks = messages.select(F.lit("gone").alias("key"), "sid", F.lit("kind").alias("kind"), F.lit("high").alias("confidence"))
    assert tuple(trace.marker_location(messages, marks).first()) == (1, 0, 1)
