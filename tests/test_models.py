"""Plain-Python models of the stateful operators, on random and hand-made inputs."""

import difflib
import hashlib
import json
import random
import re
from types import SimpleNamespace

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from turnscope import registry
from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.operators import labels, oplog, reduction, routing, rules, shape, similar, state
from turnscope.session import materialize
from turnscope.sources import catalogue as C
from turnscope.sources import raw, views
from turnscope.streaming import jobs

LOG = ("sid string, ts string, seq bigint, us bigint, chunk string, kind string, ref string, op string, "
       "text string, elapsed_ms double")


def log_of(spark, rows):
    """rows: (sid, second, kind, ref, op, text)"""
    data = [
        (sid, f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.000000Z", i, views.EPOCH_US + s * 1_000_000, None, kind, ref, op, text, 1.0)
        for i, (sid, s, kind, ref, op, text) in enumerate(rows)
    ]
    return spark.createDataFrame(data, LOG).withColumn("chunk", F.lit(None))


def best_ratio(draft, texts):
    return max([difflib.SequenceMatcher(None, draft, t).ratio() for t in texts] or [0.0])


def test_r01_against_brute_force(spark):
    log = registry.Tables(spark, SF_DIR).log
    rows = log.orderBy("sid", "ts", "seq").collect()
    expected, seen, said, drafts = set(), set(), {}, {}
    for r in rows:
        if r.kind == "queue" and r.op == "remove" and len(r.text) >= 20 and not re.match(V.SYSTEM_PREFIX, r.text):
            drafts.setdefault(r.sid, []).append(r.text)
        if r.kind != "message":
            continue
        idx = len(said.setdefault(r.sid, [])) + 1
        for d in drafts.get(r.sid, []):
            if best_ratio(d, [*said[r.sid], r.text]) < 0.55 and (r.sid, d) not in seen:
                seen.add((r.sid, d))
                expected.add((r.sid, idx, "retraction:" + hashlib.sha1(d.encode()).hexdigest()[:12]))
        said[r.sid].append(r.text)
    fires = rules.first_cause(rules.rule_r01(rules.Inputs(log)), ["R01"])
    assert {(r.sid, r.idx, r.key) for r in fires.collect()} == expected
    assert expected


def test_similarity_keeps_every_match(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta omega panel report screen".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    probes = spark.createDataFrame([("s", a, 1000) for a in set(texts[:30])], "sid string, a string, upto int")
    pool = {b: i for i, b in enumerate(texts[30:])}
    entries = spark.createDataFrame([("s", b, i) for b, i in pool.items()], "sid string, b string, first_idx int")
    for threshold in (0.55, 0.7, 0.85):
        got = {(r.a, r.hit_idx, r.hits) for r in similar.resemblance(probes, entries, threshold, True).collect()}
        expected = set()
        for a in set(texts[:30]):
            hits = [i for b, i in pool.items() if difflib.SequenceMatcher(None, a, b).ratio() >= threshold]
            if hits:
                expected.add((a, min(hits), len(hits)))
        assert got == expected


def task_digest(*tasks):
    return f"tasks:{len(tasks)}:{sum(int(hashlib.sha1(t.encode()).hexdigest()[:12], 16) for t in tasks)}"


@pytest.mark.parametrize("n", [4, 10, 64, 65, 1000])
def test_stale_tasks_have_one_form_at_every_size(spark, n):
    rows = [("s", i % 50, "launch", f"L{i}", None, None) for i in range(n)]
    rows += [("s", 60, "message", None, None, "a"), ("s", 61, "ended", "L1", None, None), ("s", 62, "ended", "L3", None, None),
             ("s", 63, "message", None, None, "b"), ("s", 64, "notified", "L0", None, None), ("s", 65, "message", None, None, "c")]
    keys = {r.idx: r.key for r in rules.rule_r02(rules.Inputs(log_of(spark, rows))).collect()}
    left = [f"L{i}" for i in range(n)]
    assert keys[1] == task_digest(*left)
    assert keys[2] == task_digest(*[t for t in left if t not in ("L1", "L3")])
    assert keys[3] == task_digest(*[t for t in left if t not in ("L0", "L1", "L3")])


def test_task_launched_in_the_same_instant_is_not_stale(spark):
    rows = [("s", 5, "launch", "L1", None, None), ("s", 5, "message", None, None, "a"), ("s", 6, "message", None, None, "b")]
    log = log_of(spark, rows)
    assert [r.idx for r in rules.rule_r02(rules.Inputs(log)).collect()] == [2]
    assert [(r.first_idx, r.last_idx) for r in state.stale_tasks(log).collect()] == [(2, 2)]


def test_nothing_later_changes_earlier_fires(spark):
    """Cutting the log after a message leaves all fires up to it unchanged."""
    log = registry.Tables(spark, SF_DIR).log.drop("chunk").withColumn("chunk", F.lit(None)).cache()
    cut = "2024-01-01T01:00:00"
    last = state.messages(log).where(F.col("ts") < cut).groupBy("sid").agg(F.max("idx").alias("last"))

    def fires(part):
        out = rules.evaluate(rules.Inputs(part))
        return {(r.sid, r.idx, r.rule, r.key) for r in out.join(last, "sid").where("idx <= last").collect()}

    assert fires(log) == fires(log.where(F.col("ts") < cut))


def test_old_queue_operations_are_forgotten(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_QUEUE_OPS", 2)
    text = "a draft that was never sent to anyone"
    rows = [("s", 1, "queue", None, "remove", text)] + [("s", 2, "queue", None, "enqueue", "")] * 2
    rows += [("s", 9, "message", None, None, "zzz"), ("t", 1, "queue", None, "remove", text), ("t", 2, "message", None, None, "zzz")]
    assert {r.sid for r in rules.rule_r01(rules.Inputs(log_of(spark, rows))).collect()} == {"t"}


def epochs_by_spans(events):
    """(epoch, in flight, base) of every event: a compaction spans from its start to the next end, or to the last event."""
    line = "".join({"PreCompact": "(", "PostCompact": ")"}.get(e, ".") for e in events)
    spans = [m.span() for m in re.finditer(r"\([^)]*\)?", line)]
    inside = {i for a, b in spans for i in range(a + 1, b)}
    starts = {a for a, _ in spans}
    closed = [b - 1 for a, b in spans if line[b - 1] == ")"]
    return [(None if i in inside else sum(c < i for c in closed), i in inside, i in starts) for i in range(len(line))]


@pytest.mark.parametrize("limit", ["1000000", "10"])
def test_epoch_plan_against_spans(spark, limit):
    rng = random.Random(11)
    names = ["PreCompact", "PostCompact", "Stop", None]
    sessions = {f"s{i}": [rng.choice(names) for _ in range(rng.randint(1, 60))] for i in range(40)}
    rows = [(s, i * 500, e, True, 1) for s, es in sessions.items() for i, e in enumerate(es)]
    spark.conf.set("turnscope.hotRows", limit)
    try:
        plan = reduction.epoch_plan(spark.createDataFrame(rows, "sid string, count bigint, event string, exists boolean, bytes bigint"))
        got = {(r.sid, r["count"]): (r.epoch, r.in_flight, r.is_base) for r in plan.collect()}
    finally:
        spark.conf.unset("turnscope.hotRows")
    for s, es in sessions.items():
        for i, want in enumerate(epochs_by_spans(es)):
            assert got[(s, i * 500)] == want


def test_large_bases_hash_like_small_ones(spark):
    captures = views.captures(spark, SF_DIR)
    native = reduction.reduction_index(captures).orderBy("sid", "count").collect()
    arrow = reduction.reduction_index(captures, native_bytes=0).orderBy("sid", "count").collect()
    assert native == arrow


def test_reconstruction_is_exact(spark):
    captures = views.captures(spark, SF_DIR)
    index = reduction.reduction_index(captures)
    rebuilt = reduction.reconstruct_capture(index, reduction.reduced_store(index, captures))
    original = captures.where("content IS NOT NULL").select("sid", "count", F.col("content").alias("want"))
    joined = rebuilt.join(original, ["sid", "count"], "full")
    assert joined.where("NOT (content <=> want)").count() == 0


REPLIES = {
    "applies": ["yes", "Yes!", "> yes", "do it", "well, go ahead", "right then, yes", "(correct)", "true enough"],
    "does-not-apply": ["nope", "ok, no", "do not do it", "not relevant here", "don't", "never mind that", "actually wrong"],
    "unlabelled": ["nobody knows", "right then", "", "  ", "maybe", "x" * 201, "no " + "y" * 198, "so and but", "trueish"],
}


def test_reply_verdicts(spark):
    df = spark.createDataFrame([(r,) for replies in REPLIES.values() for r in replies], "t string")
    got = {r.t: r.v for r in df.select("t", X.reply_verdict("t").alias("v")).collect()}
    assert got == {t: v for v, replies in REPLIES.items() for t in replies}


def test_tokens_follow_unicode_words(spark):
    texts = ["Éviction naïve_test x-ray the WITH café", "don't stop-me now_ 9lives", ""]
    stop = set(V.STOP_WORDS)
    model = {t: sorted({w for w in re.findall(r"[a-zA-Z_][\w\-]{3,}", t.lower())} - stop) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens("t").alias("k"))
    assert {r.t: r.k for r in df.collect()} == model


def test_synthetic_label_withdraws(spark):
    rows = [
        (1, "R1", "a", "applies", False), (2, "R1", "a", "does-not-apply", True), (3, "R1", "b", "applies", False),
        (4, "R1", "b", "unlabelled", False), (5, "R1", "c", "applies", True), (6, "R1", "c", "does-not-apply", False),
    ]
    df = spark.createDataFrame(rows, "ord int, rule string, fire_key string, verdict string, synthetic boolean")
    assert {(r.fire_key, r.applies) for r in labels.labels_resolved(df).collect()} == {("b", True), ("c", False)}
    assert {(r.fire_key, r.verdict) for r in labels.labels_latest(df).collect()} == {
        ("a", "does-not-apply"), ("b", "applies"), ("c", "does-not-apply")}


def test_corrections_fall_back_to_wording(spark):
    rows = [
        ("s", 1, "message", None, None, "see /clients/cases"), ("s", 2, "message", None, None, "clients and cases are wrong"),
        ("s", 3, "message", None, None, "the clients cases again"),
    ]
    log = log_of(spark, rows)
    fires = rules.rule_r05(rules.Inputs(log))
    msgs = state.messages(log)
    none = spark.createDataFrame([], "key string")
    assert [r.hit_idx for r in labels.later_correction(fires, msgs, none).collect()] == [2]
    marked = msgs.where("idx = 3").select(X.message_key("sid", "text").alias("key"))
    assert [r.hit_idx for r in labels.later_correction(fires, msgs, marked).collect()] == [3]


def test_bands_pick_exact_elements(spark):
    rng = random.Random(5)
    xs = [round(rng.expovariate(0.02), 2) for _ in range(997)]
    df = spark.createDataFrame([("b", x) for x in xs], "band string, value double")
    r = oplog.bands(df).first()
    s = sorted(xs)
    assert (r["n"], r["median"], r["p95"], r["max"]) == (997, s[997 // 2], s[int(997 * 0.95)], s[-1])


@pytest.mark.parametrize("phase", [2, 3])
def test_ask_budget_model(spark, phase):
    rng = random.Random(9)
    names = ["R10", "R11", "R04", "R12", "R13", "R01"]
    rows = []
    for sid in ("a", "b"):
        for idx in range(1, 40):
            for rule in sorted(rng.sample(names, rng.randint(0, 4))):
                rows.append((sid, f"{idx:04d}", idx, idx, None, idx, rule, f"{rule}:{rng.randint(0, 8)}", "w", "d", []))
    fires = spark.createDataFrame(
        rows, "sid string, ts string, seq bigint, us bigint, chunk string, idx bigint, rule string, key string, why string, detail string, subject array<string>"
    ).withColumn("chunk", F.lit(None))
    catalogue = {r.rule: r for r in C.packaged(spark).select("rule", C.action().alias("action"), "template").collect()}
    asking = {r for r, c in catalogue.items() if c.action not in ("augment", "log", "skip")}
    expected = set()
    for sid in ("a", "b"):
        own = [(r[5], r[6], r[7]) for r in rows if r[0] == sid]
        first = {key: idx for idx, _, key in reversed(own)}
        wanting = [(idx, key) for idx, rule, key in own if rule in asking and catalogue[rule].template and first[key] == idx]
        granted = set(wanting[:5]) if phase == 3 else set()
        spent_after = wanting[4] if phase == 3 and len(wanting) > 4 else None
        order = {(idx, key): n for n, (idx, _, key) in enumerate(own)}
        for idx, rule, key in own:
            c = catalogue[rule]
            if c.action == "augment":
                expected.add((sid, idx, rule, key, c.template is not None, False, None))
                continue
            repeated = first[key] != idx
            late = spent_after is not None and order[idx, key] > order[spent_after]
            reasons = [(c.action == "log", "precision-floor"), (phase == 2, "phase-2"), (late, "ask-budget"), (c.template is None, "no-template")]
            why = None if repeated else next((name for holds, name in reasons if holds), None)
            expected.add((sid, idx, rule, key, (idx, key) in granted, repeated, why))
    routed = routing.fire_routing(fires, C.packaged(spark), phase)
    got = {(r.sid, r.idx, r.rule, r.key, r.surfaced, r.deduped, r.suppressed) for r in routed.collect()}
    assert got == expected


def test_catalogue_defaults(spark):
    params = {(r.rule, r.name): r.value for r in C.rule_params(C.packaged(spark)).collect()}
    assert params == V.DEFAULT_PARAMS  # a null in the file falls back
    assert C.engine_setting("precision_floor", 0.9) == 0.3
    assert C.engine_setting("normalise.model", "m") == "m"
    assert C.engine_setting("normalise.timeout_s", 1.5) == 1.5
    assert C.engine_setting("no.such", 7) == 7


def test_capture_files_from_disk(spark, tmp_path):
    lines = [
        json.dumps({"session_id": "s", "count": 1, "event": "Stop", "payload": {"a": [1]}}), "", "{torn",
        json.dumps({"session_id": "s", "count": 1, "event": "Later"}), json.dumps({"session_id": "s", "count": "2"}),
        json.dumps({"session_id": "s", "count": 2.5}), json.dumps({"session_id": "s", "count": 3, "snapshot_error": "gone"}),
    ]
    (tmp_path / "s.events.jsonl").write_text("\n".join(lines))
    (tmp_path / "s.1.transcript.jsonl").write_bytes(b"one\n")
    (tmp_path / "t.v2.12.transcript.jsonl").write_bytes(b"x")
    (tmp_path / "s.count").write_text("3")
    rows = {r["count"]: r for r in raw.scan_capture_events(spark, str(tmp_path / "s.events.jsonl")).collect()}
    assert set(rows) == {1, 3} and rows[1].event == "Stop" and rows[1].payload == '{"a":[1]}' and rows[3].snapshot_error == "gone"
    snaps = {(r.sid, r["count"], r.length) for r in raw.scan_snapshots(spark, str(tmp_path)).collect()}
    assert snaps == {("s", 1, 4), ("t.v2", 12, 1)}
    listing = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.sid for r in raw.discover_sessions(listing).collect()} == {"s", "t.v2"}


def test_transcript_from_disk(spark, tmp_path):
    def user(uuid, ts, content, **more):
        return json.dumps({"type": "user", "uuid": uuid, "timestamp": ts, "message": {"content": content}, **more})

    long = [
        user("1", "2024-01-01T00:00:01Z", "plain"), user("2", "2024-01-01T00:00:02Z", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]),
        user("3", "2024-01-01T00:00:03Z", "[looks like an array"), user("4", None, "no time"),
        user("5", "2024-01-01T00:00:05Z", "  <system-reminder>x"), user("6", "2024-01-01T00:00:06Z", "meta", isMeta=True), '{"type": "user", "uu',
    ]
    (tmp_path / "s.epoch0.jsonl").write_text("\n".join(long))
    (tmp_path / "s.epoch1.jsonl").write_text(user("1", "2024-01-01T00:00:01Z", "stale copy"))
    events = shape.ordered_events(raw.scan_transcript_lines(spark, str(tmp_path)))
    got = [(r.ts, r.text) for r in shape.human_messages(events).orderBy("seq").collect()]
    assert got == [("", "no time"), ("2024-01-01T00:00:01Z", "plain"), ("2024-01-01T00:00:02Z", "a b"), ("2024-01-01T00:00:03Z", "[looks like an array")]


def test_raw_and_direct_facts_agree(spark):
    direct = registry.Tables(spark, SF_DIR)
    facts = materialize(state.marked(shape.to_facts(materialize(direct.lines, "lines"))), "facts")
    got = rules.evaluate(rules.Inputs(facts), ["R02", "R03", "R04", "R05", "R12"])
    want = rules.evaluate(rules.Inputs(direct.log), ["R02", "R03", "R04", "R05", "R12"])
    columns = ("sid", "idx", "rule", "key")
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0
    assert want.select(*columns).exceptAll(got.select(*columns)).count() == 0


def test_stream_dedupe_keeps_rows_of_every_file(spark):
    """Nine sessions in five of eight partitions: a slice has fewer files than there are partitions.

    By default Spark drops late rows by the watermark of one trigger before, which hid triggers that split a slice.
    """
    rows = [(f"s{s}", 5 * k, "queue", None, "remove", "x") for s in range(9) for k in range(720)]
    own = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.streaming.statefulOperator.allowMultiple": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = jobs.stream_dedupe(SimpleNamespace(spark=spark, log=log_of(spark, rows))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.kind, r.n) for r in got] == [("queue", len(rows))]


def test_notifications_order_the_lines_once(spark):
    """Attached and typed notifications come from one pass: the plan reads and sorts the lines in one branch."""
    plan = shape.task_notifications(registry.Tables(spark, SF_DIR).lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("min_by") == 1
