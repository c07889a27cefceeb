"""Streaming queries and the file round trips that feed them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.operators import rules, state
from turnscope.plans.ordered import scan, with_chunks
from turnscope.session import ROCKSDB, materialize, scratch_path
from turnscope.sources import catalogue as C
from turnscope.sources import raw, views
from turnscope.sources.tail import tail_lines
from turnscope.streaming import session

SLICES = 3
FAN = 64  # entries of a node of a search tree


# ---- file round trips -------------------------------------------------------------------------

def write_lines(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch_path(spark, "lines")
    lines.select("line").write.text(path)
    return path


def write_event_lines(spark: SparkSession, captures: DataFrame) -> str:
    return write_lines(spark, views.event_lines(captures))


def catalogue_roundtrip(spark: SparkSession, catalogue: DataFrame) -> DataFrame:
    """Write the catalogue (a few rows) as one JSON document and scan it back."""
    entry = F.struct(
        F.col("rule").alias("id"), "action", "suspended", "suspended_reason", "params",
        F.struct("precision", F.struct("basis", "refuted", "hand_labelled").alias("backtest")).alias("metrics"),
        F.col("template").alias("fix"))
    path = scratch_path(spark, "catalogue")
    catalogue.agg(F.collect_list(entry).alias("rules")).write.json(path)
    return C.scan_catalogue(spark, path)


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends a batch of log rows as JSON lines below its own folder, by date.

    A batch that is written again, after a failure between write and checkpoint, replaces what it wrote before.
    """
    def write(rows: DataFrame, batch: int) -> None:
        dated = rows.withColumn("date", F.substring("ts", 1, 10))
        dated.write.mode("overwrite").partitionBy("date").json(f"{path}/batch={batch}")
    return write


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path).select(*[f.name for f in schema])


def append_and_read(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Append the log as a stream in two runs and read it back."""
    source, path, checkpoint = (scratch_path(spark, n) for n in ("fires-in", "fires", "fires-checkpoint"))
    for half in (0, 1):
        rows.where(f"idx % 2 = {half}").write.mode("append").parquet(source)
        spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(append_batch(path)).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_log(spark, path, rows.schema)


# ---- streams ----------------------------------------------------------------------------------

def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def time_slices(rows: DataFrame, slices: int = SLICES) -> list[DataFrame]:
    """The rows in time order as a few parts, the way a log grows.

    The cuts divide the span of the data itself; rows without a time come first.
    """
    span = rows.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    low, step = span.low or 0, ((span.high or 0) - (span.low or 0)) // slices + 1
    n = F.coalesce(F.floor((F.col("us") - low) / step), F.lit(0))
    return [rows.where(n == i) for i in range(slices)]


def replay(spark: SparkSession, rows: DataFrame, plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run a plan over the rows as a stream into a table of files, and read that table.

    A slice is appended and then taken whole by one trigger, however many files it has: every run goes on from the
    checkpoint of the one before. So the watermark never passes rows of a slice that is not read to its end.
    """
    source, sink, checkpoint = (scratch_path(spark, name + end) for end in ("-in", "", "-checkpoint"))
    for part in time_slices(rows):
        part.repartition("sid").write.mode("append").parquet(source)
        out = plan(spark.readStream.schema(rows.schema).parquet(source))
        query = (
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
        if late:
            raise RuntimeError(f"{name}: {late} rows came after the watermark and were dropped")
    return spark.read.schema(out.schema).parquet(sink)


def sequence(stream: DataFrame) -> DataFrame:
    """Per-session numbers 1, 2, 3 ... over a stream with sid, ts, seq."""
    return stream.groupBy("sid").transformWithState(
        session.Sequence(), "sid string, seq bigint, n bigint", "Append", "None")


def down_times(probes: DataFrame) -> DataFrame:
    """url, nth, since, until: when the latest probe says that a URL does not answer, and how many probes of it came
    before; ``until`` NULL while it stays so. The times of a URL do not overlap."""
    placed = with_chunks(probes.select("url", "ts", "seq", "serves"), key="url", order="ts")
    turns = scan(placed, ["url"], ["ts", "seq"], nexts={"next": F.struct("ts")}, sums={"nth": F.lit(1).cast("long")})
    return turns.where("serves = false").select(
        "url", "nth", F.col("ts").alias("since"), F.col("next.ts").alias("until")).where("until IS NULL OR since < until")


def search_tree(down: DataFrame) -> list[DataFrame]:
    """The down times of every URL as the levels of a search tree, root first: url, node, entries in order of ``since``.

    A leaf holds the times of ``FAN`` probes, a higher node the beginnings of ``FAN`` nodes below it. So a lookup
    reads a few short arrays, and the work grows with the lookups, not with lookups times down times of the same URL.
    """
    def nodes(entries: DataFrame, place: str, *entry: Column) -> DataFrame:
        grouped = entries.groupBy("url", F.expr(f"{place} div {FAN}").alias("node"))
        return materialize(grouped.agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("entries")), "down")

    levels = [nodes(down, "nth", F.col("since"), F.col("until"))]
    while levels[0].agg(F.max("node")).first()[0]:
        levels.insert(0, nodes(levels[0], "node", F.col("entries")[0]["since"].alias("since"), F.col("node").alias("child")))
    return levels


def at_time(urls: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """Those of the urls (url, ts, ...) that did not answer at their time, found from the root down."""
    latest = F.try_element_at(F.filter("entries", lambda e: e["since"] <= F.col("ts")), F.lit(-1))
    found = urls.withColumn("node", F.lit(0).cast("long"))
    for nodes in tree[:-1]:
        found = found.join(nodes, ["url", "node"]).select(*urls.columns, latest["child"].alias("node")).where("node IS NOT NULL")
    times = found.join(tree[-1], ["url", "node"]).select(*urls.columns, latest.alias("down"))
    return times.where("down IS NOT NULL AND (down.until IS NULL OR ts < down.until)").drop("down")


def faults_of_messages(facts: DataFrame, known: DataFrame, down: list[DataFrame]) -> DataFrame:
    """References no inventory knows and URLs that did not answer at the time, as facts placed before their message.

    Joins of the stream with tables: what a message cites is looked up as it comes, and nothing is kept.
    """
    said = facts.where("kind = 'message'").select("sid", "ts", "seq", "us", "text")
    place = ["sid", "ts", "seq", "us"]
    cited = said.select(*place, F.explode(X.references("text", V.PATH, V.REPO)).alias("ref"))
    missing = cited.join(known.select("ref"), "ref", "left_anti").select(
        *place, F.lit(session.MISSING).alias("kind"), F.col("ref").alias("value"))
    urls = said.select(*place, F.explode(X.references("text", V.URL)).alias("url"))
    dead = at_time(urls, down).select(*place, F.lit(session.DEAD).alias("kind"), F.col("url").alias("value"))
    return missing.unionByName(dead)


def session_features(
    facts: DataFrame, params: dict[tuple[str, str], float], known: DataFrame | None = None,
    down: list[DataFrame] | None = None, every: bool = False,
) -> DataFrame:
    """sid and what the session processor reads of a fact, text rules and reply verdict included, as one JSON text: a row
    crosses to Python at the price of two columns. Facts that change nothing are left out unless ``every`` is wanted.
    ``known`` and ``down`` are the tables beside the log; without them R06 and R08 stay silent, as in batch."""
    kind, ref = F.col("kind"), F.col("ref")
    fires = F.array_compact(F.array(*[
        F.when(condition, F.array(F.lit(rule), key))
        for rule, (condition, key) in ((r, make()) for r, make in rules.TEXT_RULES.items())
    ]))
    long_enough = F.length("text") >= int(params["R01", "min_chars"])
    message = kind == "message"
    role = (
        F.when(message | (kind == "api_error"), kind)
        .when(kind.isin("launch", "question") & ref.isNotNull(), kind)
        .when(kind.isin("notified", "ended") & (ref != ""), "ended")
        .when(kind.isin("denial", "question_denial") & (ref != ""), "denial")
        .when(state.human_queue_op() & (F.col("op") == "remove") & long_enough, "draft")
        .when((kind == "queue") & (F.col("op") == "dequeue"), "dequeue")
    )
    roles = facts.withColumn("role", role)
    features = (roles if every else roles.where("role IS NOT NULL")).select(
        "sid", "ts", "seq", "us", F.col("role").alias("kind"),
        F.when(F.col("role").isin("message", "draft"), F.col("text"))
        .when(F.col("role") == "dequeue", rules.iso_offset("us")).otherwise(ref).alias("value"),
        F.when(message, fires).alias("fires"), F.when(message, X.reply_verdict("text")).alias("reply"), F.lit(1).alias("turn"),
    )
    if known is not None and down is not None:
        faults = faults_of_messages(facts, known, down).withColumn("turn", F.lit(0))
        features = features.unionByName(faults, allowMissingColumns=True)
    fact = F.struct(*[c for c in features.columns if c != "sid"])
    return features.select("sid", F.to_json(fact, {"ignoreNullFields": "true"}).alias("fact"))


def route_session(
    stream: DataFrame, policies: dict[str, session.Policy], budget: int, params: dict[tuple[str, str], float] = V.DEFAULT_PARAMS,
    known: DataFrame | None = None, down: list[DataFrame] | None = None, idle_s: float | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Fires and verdicts of a stream of facts. With ``idle_s`` sessions end that long after their last row, by a watermark
    that lags by ``delay``; the rows go on without the watermark's column, so none is dropped as late."""
    if idle_s is not None:
        stream = stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    features = session_features(stream, params, known, down, every=idle_s is not None)
    told = features.groupBy("sid").transformWithState(
        session.Session(policies, budget, params, idle_s), session.OUT, "Append", "None" if idle_s is None else "EventTime")
    return told.select("sid", F.inline(F.from_json("told", session.TOLD, {"mode": "FAILFAST"})))


def catalogue_policies(catalogue: DataFrame) -> dict[str, session.Policy]:
    """What each rule's fires can lead to: a dozen rows on the driver."""
    rows = catalogue.select("rule", C.action().alias("action"), F.col("template").isNotNull().alias("says"))
    return {r["rule"]: session.policy(r["action"], r["says"]) for r in rows.collect()}


def routed_stream(t) -> DataFrame:
    stateful(t.spark)
    facts = t.share().log.select("sid", "ts", "seq", "us", "kind", "ref", "op", "text")  # read by every slice
    policies, params = catalogue_policies(t.catalogue), C.params_of(t.catalogue)
    known = materialize(t.inputs.known_refs, "refs")  # tables beside the log, read again with every micro-batch
    down = search_tree(down_times(t.inputs.url_probes))
    return replay(
        t.spark, facts, lambda stream: route_session(stream, policies, C.ask_budget(), params, known, down), "session")


def stream_rules(t) -> DataFrame:
    return routed_stream(t).where("kind = 'fire'").select("sid", "idx", "rule", "key")


def stream_routing(t) -> DataFrame:
    return routed_stream(t).where("kind = 'fire'").select(
        "sid", "idx", "rule", "key", "surfaced", "deduped", "suppressed")


def stream_verdicts(t) -> DataFrame:
    return routed_stream(t).where("kind = 'verdict'").select(
        "sid", F.col("idx").alias("asked_idx"), "rule", "key", "verdict")


def stream_sequence(t) -> DataFrame:
    stateful(t.spark)
    rows = materialize(t.log.select("sid", "ts", "seq", "us"), "timed")  # read by every slice
    return replay(t.spark, rows, sequence, "sequence")


def dedupe(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First row per (session, seq) while the watermark remembers it."""
    timed = stream.withColumn("at", F.timestamp_micros("us"))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sid", "seq"])


def stream_dedupe(t) -> DataFrame:
    stateful(t.spark)
    rows = materialize(t.log.select("sid", "seq", "us", "kind"), "timed")  # read by every slice
    doubled = rows.unionByName(rows.where("seq % 10 = 0"))
    return replay(t.spark, doubled, dedupe, "dedupe").groupBy("kind").agg(F.count("*").alias("n"))


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New complete lines of a growing folder of growing log files, parsed; broken ones are dropped."""
    parsed = tail_lines(spark, path, **options).select("path", "at", "line", F.try_parse_json("line").alias("v"))
    return parsed.where("v IS NOT NULL").select(
        "path", "at", raw.variant("v", "$.type", "string").alias("type"), F.col("line").alias("value"))


def follow(spark: SparkSession, source: str, sink: str, checkpoint: str, **options: str) -> None:
    """Take what has come since the last run into a table of files."""
    tail(spark, source, **options).writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_tail(t) -> DataFrame:
    """Two runs over a folder that grows between them; the second sees only new lines."""
    spark = t.spark
    lines = views.transcript_lines(spark, t.sf_dir)
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("tail-in", "tail-out", "tail-checkpoint"))
    for part in ("place % 20 < 10", "place % 20 >= 10"):
        lines.where(part).select("line").write.mode("append").text(source)
        follow(spark, source, sink, checkpoint)
    return spark.read.schema("type string, value string").parquet(sink).groupBy("type").agg(F.count("*").alias("lines"))


# ---- windows over the fire log ----------------------------------------------------------------

WINDOW, SLIDE, GAP, DELAY = "10 minutes", "5 minutes", "5 minutes", "10 minutes"
END = "end"  # a row behind the last one closes the windows that are open


def windowed(stream: DataFrame, shape: str) -> DataFrame:
    """Counts of what (a rule, or an error) per tumbling or sliding window, or per session window of a conversation.

    A window is told once, when the watermark has passed its end; rows that come later than that are not counted.
    """
    timed = stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", DELAY)
    window = {"tumbling": F.window("at", WINDOW), "sliding": F.window("at", WINDOW, SLIDE), "session": F.session_window("at", GAP)}[shape]
    keys = ["sid"] if shape == "session" else []
    counted = timed.groupBy(window.alias("w"), *keys, "what").agg(F.count("*").alias("n"))
    sid = F.col("sid") if keys else F.lit(None).cast("string")
    return counted.select(
        F.lit(shape).alias("shape"), sid.alias("sid"), "what", F.unix_micros("w.start").alias("start_us"),
        F.unix_micros("w.end").alias("end_us"), "n")


def stream_windows(t) -> DataFrame:
    stateful(t.spark)
    fires = t.fires.select("sid", "us", F.col("rule").alias("what"))
    errors = t.log.where("kind = 'api_error'").select("sid", "us", F.lit("error").alias("what"))
    rows = materialize(fires.unionByName(errors).where("us IS NOT NULL"), "timed")
    after = rows.agg((F.max("us") + 3_600_000_000).alias("us")).where("us IS NOT NULL").select(
        F.lit("").alias("sid"), "us", F.lit(END).alias("what"))
    ended = materialize(rows.unionByName(after), "timed")
    shapes = [replay(t.spark, ended, lambda s, shape=shape: windowed(s, shape), f"windows-{shape}")
              for shape in ("tumbling", "sliding", "session")]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2]).where(F.col("what") != END)
