"""The bounds of the similarity search against plain versions, and sessions of several blocks against all pairs."""

import datetime
import difflib
import random

import numpy as np
import pyarrow as pa
from test_models import log_of

from turnscope.functions import text
from turnscope.operators import rules, similar


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def texts(rng, count, sizes, alphabet="abcdefg é."):
    return ["".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(count)]


def test_common_subsequence():
    rng = random.Random(3)
    a, b = texts(rng, 20, [1, 5, 63, 64, 65, 130, 200]), texts(rng, 20, [1, 7, 63, 64, 65, 128, 129, 250])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20)))
    got = similar.common_subsequence(similar.Texts(a), similar.Texts(b), i, j)
    assert got.tolist() == [longest(a[p], b[q]) for p, q in zip(i, j)]


def test_bounds_never_drop_a_match():
    rng = random.Random(4)
    a = texts(rng, 60, [5, 20, 40, 90, 210])
    b = a[:20] + ["".join(c for c in x if rng.random() < 0.6) for x in a] + ["x".join(x) for x in a[:10]]
    for threshold in (0.55, 0.7, 0.85):
        allowed = np.ones((len(a), len(b)), bool)
        kept = {(p, q) for i, j in similar.likely(similar.Texts(a), similar.Texts(b), allowed, threshold) for p, q in zip(i, j)}
        true = {(p, q) for p, x in enumerate(a) for q, y in enumerate(b)
                if difflib.SequenceMatcher(None, x, y).ratio() >= threshold}
        assert true and true <= kept


def test_sessions_of_several_blocks(spark):
    rng = random.Random(5)
    said = list(dict.fromkeys(texts(rng, 70, [12, 30, 50])))
    drafts = [("s", x[: -2] + "zz", rng.randint(1, 70)) for x in said[:30]] + [("s", said[3], 2), ("t", said[3], 9), ("u", said[3], 9)]
    pool = [("s", x, i) for i, x in enumerate(said)] + [("t", said[3], 4), ("t", None, 3), ("v", said[3], 1)]
    expected = set()
    for sid, a, upto in drafts:
        hits = [i for s, b, i in pool if s == sid and b is not None and i <= upto
                and (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.55)]
        if hits:
            expected.add((sid, a, upto, min(hits), len(hits)))
    probes = spark.createDataFrame(drafts, "sid string, a string, upto long")
    entries = spark.createDataFrame(pool, "sid string, b string, first_idx long")
    for block in (8, 2048):
        got = {tuple(r) for r in similar.resemblance(probes, entries, 0.55, True, block).collect()}
        assert got == expected


def test_two_decimals_of_ties(spark):
    shares = sorted({2 * m / n for n in range(2, 420) for m in range(n // 2 + 1)})
    rows = spark.createDataFrame([(x,) for x in shares], "x double").select("x", text.two_decimals("x").alias("said")).collect()
    assert {x: said for x, said in rows} == {x: f"{x:.2f}" for x in shares}  # 0.975 was 0.98


def test_repetition_at_a_tie(spark):
    """39 of 40 characters agree, and the double of 0.975 lies below the tie."""
    first, second = ("a" * 20 + x + "d" * 19 for x in "bc")
    log = log_of(spark, [("s", 0, "message", None, None, first), ("s", 5, "message", None, None, second)])
    fires = rules.rule_r07(rules.Inputs(log)).select("detail").collect()
    assert difflib.SequenceMatcher(None, first, second).ratio() == 0.975
    assert [r.detail for r in fires] == ["similarity 0.97"]


def test_enough_hits_spare_comparisons(spark):
    """The earliest hit stays exact, and so does whether there are enough; the measure runs on fewer pairs."""
    said = [f"please open the long report number {n} today" for n in range(40)] + ["abcdefgh ijkl mnop"]
    runs = {}
    for enough in (None, 1, 2):
        measured = []

        class Counting(similar.Measure):
            def alike(self, a, b, i, j):
                measured.append(len(i))
                return super().alike(a, b, i, j)

        rows = pa.RecordBatch.from_pydict({
            "sid": ["s", "t", "u"],
            "probes": [[{"a": said[0], "upto": 30}, {"a": "zzz qqq", "upto": 30}], [{"a": said[-1], "upto": 41}], [{"a": "none", "upto": 3}]],
            "pool": [[{"b": x, "first_idx": 40 - n} for n, x in enumerate(said[:40])], [{"b": x, "first_idx": n} for n, x in enumerate(said)], []],
        }, schema=pa.schema([
            ("sid", pa.string()), ("probes", pa.list_(pa.struct([("a", pa.string()), ("upto", pa.int64())]))),
            ("pool", pa.list_(pa.struct([("b", pa.string()), ("first_idx", pa.int64())])))]))
        plain, similar.Measure = similar.Measure, Counting
        try:
            found = [r for part in similar.compared(0.55, True, enough)(iter([rows])) for r in part.to_pylist()]
        finally:
            similar.Measure = plain
        runs[enough] = {(r["sid"], r["a"]): (r["hit_idx"], r["hits"]) for r in found}, sum(measured)
    all_hits, all_pairs = runs[None]
    assert all_hits == {("s", said[0]): (1, 30), ("t", said[-1]): (40, 1)}
    for enough in (1, 2):
        hits, pairs = runs[enough]
        assert {k: v[0] for k, v in hits.items()} == {k: v[0] for k, v in all_hits.items()} and pairs < all_pairs
        assert all((hits[k][1] >= enough) == (all_hits[k][1] >= enough) for k in hits)


def test_close_ratio_is_the_full_measure(spark):
    rng = random.Random(6)
    first = texts(rng, 80, [1, 25, 60, 210])
    second = ["".join(c for c in x if rng.random() < 0.9) or "x" for x in first]
    pairs = [*zip(first, second), *zip(first, reversed(second)), *zip(first, first), ("ab" * 20, "ba" * 20), ("é" * 30, "é" * 29 + "e"), ("ab " * 900, "ab " * 890 + "c")]
    rows = spark.createDataFrame(pairs * 2, "a string, b string").select("a", "b", similar.close_ratio("a", "b", 0.85).alias("x"))
    expected = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs}
    assert {(a, b): x for a, b, x in rows.collect()} == {pair: x if x >= 0.85 else None for pair, x in expected.items()}
    assert rows.where("false").collect() == []


def test_repetitions_are_bounded_outside_the_plan(spark, capsys):
    """The plan had 54 passes over the letters of every pair."""
    log = log_of(spark, [("s", 0, "message", None, None, "a" * 30), ("s", 5, "message", None, None, "a" * 31)])
    fires = rules.rule_r07(rules.Inputs(log))
    fires.explain()
    assert "translate(" not in capsys.readouterr().out
    assert fires.count() == 1


def test_iso_text_of_any_time(spark):
    times = [0, 1, 999_999, 86_399_999_999, 86_400_000_000, 1_704_067_200_000_000, 1_709_210_096_123_456, -1, -86_400_000_000]
    start = datetime.datetime(1970, 1, 1)
    said = spark.createDataFrame([(t,) for t in times], "us long").select("us", text.iso("us").alias("iso")).collect()
    # a time before 1970 had negative parts
    assert dict(said) == {t: (start + datetime.timedelta(microseconds=t)).strftime("%Y-%m-%dT%H:%M:%S.%fZ") for t in times}
