"""The live rules: what crosses to Python and what is kept, against batch and against plain models."""

import difflib
import random

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_models import log_of

from turnscope import registry
from turnscope.functions import vocab as V
from turnscope.operators import rules, similar
from turnscope.session import scratch_path
from turnscope.sources import catalogue as C
from turnscope.streaming import jobs, session


def tables_of(spark, rows):
    tables = registry.Tables(spark, SF_DIR)
    tables.log = log_of(spark, rows)
    return tables


def told(df):
    return sorted(tuple(r) for r in df.select("sid", "idx", "rule", "key").collect())


def test_long_sessions_equal_batch(spark):
    """Known keys of 100 facts of 300 characters outgrow the head in every part of the stream."""
    rng = random.Random(5)
    words = ["see /clients/9/cases", "as good as possible", "\"quoted\" \\ \n line", "no more screens", "größe ☃ 𝄞  ", "the summary panel"]
    open_url = "open http://localhost:3000/health and https://example.org/status please"
    rows, at = [], 0
    for n in range(360):
        sid, at = f"s{n % 3}", at + rng.randint(1, 17)
        text = " ".join(rng.choices(words, k=3)) + f" {n} github.com/acme/widget{n} " + "".join(rng.choices("abcdefgh ", k=300 if sid != "s2" else 10))
        kind = rng.choice(["message"] * 4 + ["remove", "dequeue", "api_error", "launch", "ended", "question", "denial"])
        ref = {"launch": f"L{n}", "ended": f"L{rng.randint(0, n)}", "question": f"Q{n}", "denial": f"Q{rng.randint(0, n)}"}.get(kind)
        if kind in ("remove", "dequeue"):
            kind, op = "queue", kind
        else:
            op = "clarify" if kind == "denial" else None
        said = rng.choice([text, text, open_url]) if kind in ("message", "queue") else None
        rows.append((sid, at, kind, ref, op, said))
        if n % 10 == 0:
            rows.append((sid, at, "launch", None, None, None))  # a task without a name is none
        if n % 12 == 0 and kind == "message":
            rows.append((sid, at + 1, "queue", None, "remove", said[:200]))
    tables = tables_of(spark, rows)
    got = told(jobs.stream_rules(tables))
    want = told(rules.evaluate(tables.inputs))
    assert got == want
    assert {r[2] for r in got} >= {"R01", "R02", "R03", "R04", "R05", "R06", "R08", "R10", "R11", "R12", "R13"}


def test_a_short_session_keeps_one_row(spark):
    jobs.stateful(spark)
    rows = [(f"s{s}", 9 * n + s, "message", None, None, f"see {n} /clients/cases as good as possible") for s in range(5) for n in range(20)]
    log = log_of(spark, rows).drop("chunk")
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("one-in", "one-out", "one-checkpoint"))
    log.write.parquet(source)
    out = jobs.route_session(spark.readStream.schema(log.schema).parquet(source), jobs.catalogue_policies(C.packaged(spark)), 3, V.DEFAULT_PARAMS)
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 5
    fires = spark.read.parquet(sink).where("kind = 'fire'")  # more of a session than one text holds
    assert {r["count"] for r in fires.groupBy("sid").count().collect()} == {20 * 3 + 1 + 19}
    assert fires.where("rule = 'R13'").select("sid", "idx").distinct().count() == 100


class Kept(dict):
    """A map state that counts the calls made to it."""

    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def keys(self):
        return iter(list(super().keys()))


def test_known_keys_move_when_they_grow_long():
    state = Kept()
    known = session.Known(state, [], False)
    for n in range(100):
        known.add(f"k{n}")
    assert "k7" in known and "k100" not in known
    recent, moved = known.kept(1)
    assert len(recent) == 100 and not moved and state.calls == 0
    known = session.Known(state, recent, moved)
    known.add("x" * session.RECENT)
    assert known.kept(2) == ([], True) and len(state) == 101
    known = session.Known(state, [], True)
    known.add("new")
    assert "k7" in known and "new" in known and "other" not in known
    before = state.calls
    assert "k7" in known and "other" not in known and state.calls == before  # asked for once in a micro-batch
    assert sorted(known.keys()) == sorted(["new", "x" * session.RECENT, *[f"k{n}" for n in range(100)]])


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_down_times_are_found_in_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(jobs, "FAN", fan)
    rng = random.Random(fan)
    stamps = ["", *[f"2024-01-01T00:00:{s:02d}.{f}Z" for s in range(40) for f in ("000000", "500000")], "2024-01-01T00:00:07Z"]
    probes = [(f"u{rng.choice([0, 0, 0, 1, 2])}", rng.choice(stamps), n, rng.choice([True, False, False, None])) for n in range(150)]
    probes += [("never", "2024-01-01T00:00:01Z", 500, False), ("up", "2024-01-01T00:00:01Z", 501, True)]
    asked = [(u, ts) for u in ("u0", "u1", "u2", "never", "up", "unknown") for ts in stamps]
    tree = jobs.search_tree(jobs.down_times(spark.createDataFrame(probes, "url string, ts string, seq long, serves boolean").withColumn("us", F.lit(0))))
    assert all(nodes.agg(F.max(F.size("entries"))).first()[0] <= fan for nodes in tree)
    assert len(tree) > 1 if fan < 64 else len(tree) == 2
    got = sorted(tuple(r) for r in jobs.at_time(spark.createDataFrame(asked, "url string, ts string"), tree).collect())
    want = []
    for url, ts in asked:
        latest = max(((t, n, serves) for u, t, n, serves in probes if u == url and t <= ts), default=(0, 0, None), key=lambda p: p[:2])
        if latest[2] is False:
            want.append((url, ts))
    assert got == sorted(want) and got


def test_no_probe_at_all(spark):
    tree = jobs.search_tree(jobs.down_times(spark.createDataFrame([], "url string, ts string, seq long, serves boolean")))
    assert jobs.at_time(spark.createDataFrame([("u", "t")], "url string, ts string"), tree).count() == 0


def test_bounds_never_rule_out_a_match():
    rng = random.Random(8)
    hits = 0
    for _ in range(1500):
        n = rng.choice([0, 1, 6, 40, 120, 210, 1100])
        text = "".join(rng.choice("abcd é𝄞") for _ in range(n))
        others = []
        for _ in range(rng.randint(0, 2)):
            other = list(text)
            for _ in range(rng.randint(0, n // 2 + 2)):
                other[rng.randint(0, len(other)):][:1] = rng.choice("abcdx ")
                other.insert(rng.randint(0, len(other)), rng.choice("abcdx "))
            others.append("".join(other))
        threshold = rng.choice([0.55, 0.7, 0.85])
        want = any(difflib.SequenceMatcher(None, text, other).ratio() >= threshold for other in others)
        assert similar.resembles_any(text, others, threshold) == want
        hits += want
    assert 200 < hits < 1300
