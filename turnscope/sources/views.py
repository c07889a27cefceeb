"""Session-log views over the driver's tables.

The tables hold no conversation logs with timestamps, so a log is derived from ``events``:
each user is a session and each event becomes one fact. Times are compressed 360-fold, otherwise
the 90 s and 120 s rules could never match. Everything is a projection or an ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.plans.ordered import scan, with_chunks

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
COMPRESSION = 360

# '#' is replaced by the event's number
TEMPLATES = (
    "please look at /clients/{id}/cases and /users/# before the demo",
    "the helper lives in ../services/crm/main# and the notes in ./docs/readme.md",
    "compare this with github.com/acme/widget# when you have time",
    "open http://localhost:30#/health and then https://example.org/status please",
    "tidy the importer and keep it as good as possible for case #",
    "there must not be any more screen options on page #",
    "the summary panel should be visible to every reviewer of batch #",
    "the summary panel should not be visible to every reviewer of batch #",
    "that is wrong, the clients and cases list moved to the users area #",
    "i already told you, the export still isn't working for client #",
    "is it stuck or still running after # minutes?",
    "that's not what i asked for on ticket #",
    "i only asked for one change, this is too much for ticket #",
    "please revert the cases patch for clients and start again from scratch on branch #",
    "yes, go ahead with number #",
    "no, never mind number #",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events with session id, compressed time and number ``k``."""
    offset = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sid"),
        F.col("event_id").alias("seq"),
        (F.lit(EPOCH_US) + F.expr(f"({offset}) div {COMPRESSION}")).alias("us"),
        "event_type",
        F.col("value").alias("elapsed_ms"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    return raw.withColumn("ts", X.iso("us"))


def template_text(seq: Column, k: Column) -> Column:
    bodies = F.expr(X.sql_array(TEMPLATES))
    return F.replace(F.element_at(bodies, (seq % 16 + 1).cast("int")), F.lit("#"), F.coalesce(k, F.lit("")))


FACT_KIND = """
CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'queue' WHEN 'error' THEN 'api_error'
  WHEN 'signup' THEN CASE WHEN seq % 2 = 0 THEN 'launch' ELSE 'question' END
  ELSE CASE WHEN seq % 3 = 0 THEN 'denial' WHEN seq % 3 = 1 THEN 'notified'
    WHEN seq % 5 = 0 THEN 'stop_failed' ELSE 'ended' END END
"""
FACT_OP = """
CASE kind WHEN 'queue' THEN element_at(array('enqueue', 'remove', 'dequeue'), CAST(seq % 3 + 1 AS INT))
  WHEN 'denial' THEN CASE WHEN seq % 2 = 0 THEN 'clarify' ELSE 'user-rejected' END END
"""
FACT_TEXT = """
CASE kind WHEN 'message' THEN template WHEN 'launch' THEN concat('working on item ', k)
  WHEN 'queue' THEN CASE WHEN seq % 7 = 0 THEN '' WHEN seq % 7 = 1
    THEN '<system-reminder>note</system-reminder>' ELSE template END END
"""
FACT_REF = """
CASE WHEN kind = 'launch' THEN concat('L', seq) WHEN kind = 'question' THEN concat('Q', seq)
  WHEN kind IN ('notified', 'ended', 'stop_failed') THEN concat('L', _launch)
  WHEN kind = 'denial' THEN concat('Q', _question) END
"""


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact stream: one row per thing that happened, in (sid, ts, seq) order.

    Columns: sid, ts, seq, us, chunk, kind, ref (task or question id), op (queue operation or
    denial kind), text, elapsed_ms.
    """
    users = table(spark, sf_dir, "events").select(F.expr("CAST(user_id AS STRING) AS sid"))
    rows = (
        with_chunks(events(spark, sf_dir), sizes=users)
        .select("*", F.expr(FACT_KIND).alias("kind"))
        .select("*", F.when(F.col("kind").isin("message", "queue"), template_text(F.col("seq"), F.col("k"))).alias("template"))
        .select("*", F.expr(FACT_OP).alias("op"), F.expr(FACT_TEXT).alias("text"))
    )
    linked = scan(
        rows, ["sid"], ["ts", "seq"],
        lasts={
            "_launch": F.expr("CASE WHEN kind = 'launch' THEN seq END"),
            "_question": F.expr("CASE WHEN kind = 'question' THEN seq END"),
        },
    )
    return linked.select(
        "sid", "ts", "seq", "us", "chunk", "kind", F.expr(FACT_REF).alias("ref"), "op", "text", "elapsed_ms"
    )


def known_refs(messages: DataFrame) -> DataFrame:
    """The inventory: references mentioned by every second group of sixteen events."""
    return (
        messages.where(F.expr("(seq div 16) % 2 = 0"))
        .select(F.explode(X.references("text", V.PATH, V.REPO)).alias("ref"))
        .distinct()
    )


def url_probes(log: DataFrame) -> DataFrame:
    """(url, ts, us, serves): probe results through time; ``serves`` NULL means unknown."""
    seq = F.col("seq")
    url = F.when(seq % 4 == 0, "https://example.org/status").otherwise(
        F.concat(F.lit("http://localhost:30"), F.expr("seq % 100"), F.lit("/health"))
    )
    return log.where("kind = 'api_error'").select(
        url.alias("url"), "ts", "us", "seq",
        F.when(seq % 3 == 0, True).when(seq % 3 == 1, False).alias("serves"),
    )


def desync_verdicts(messages: DataFrame) -> DataFrame:
    """External judgements, one row per write; some keys are written twice."""
    seq = F.col("seq")
    writes = messages.select("*", F.explode(
        F.when(seq % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ).alias("write"))
    yes = (seq + F.col("write")) % 5 == 0
    kinds = F.expr(X.sql_array(V.DESYNC_KINDS[:-1]))
    levels = F.expr(X.sql_array(V.CONFIDENCE))
    return writes.select(
        X.message_key("sid", "text").alias("key"),
        "sid",
        (seq * 2 + F.col("write")).alias("ord"),
        yes.alias("desync"),
        F.when(yes | (seq % 31 == 0), F.element_at(kinds, (seq % 6 + 1).cast("int"))).otherwise("none").alias("kind"),
        F.element_at(levels, (seq % 3 + 1).cast("int")).alias("confidence"),
        F.when(seq % 4 == 0, F.substring("text", 1, 12)).when(seq % 4 == 1, "not in it").otherwise("").alias("quote"),
        F.when(yes & (seq % 6 == 2), F.concat(F.lit("item "), F.expr("seq % 10"))).otherwise("").alias("contradicts"),
        F.substring(X.strip(X.squash("text")), 1, 300).alias("text"),
    )


def directive_verdicts(messages: DataFrame) -> DataFrame:
    seq = F.col("seq")
    strength = (
        F.when(seq % 4 == 0, "direct").when(seq % 4 == 3, "none").otherwise("weakened")
    )
    flags = (strength == "weakened") | (seq % 29 == 0)

    def bit(n: int) -> Column:
        return flags & (F.expr(f"(seq div {n}) % 2") == 1)

    levels = F.expr(X.sql_array(V.CONFIDENCE))
    return messages.select(
        X.message_key("sid", "text").alias("key"),
        "sid",
        seq.alias("ord"),
        (strength != "none").alias("is_directive"),
        strength.alias("strength"),
        bit(4).alias("hedged"),
        bit(8).alias("understated"),
        bit(16).alias("interrogative"),
        bit(32).alias("optative"),
        F.element_at(levels, (seq % 3 + 1).cast("int")).alias("confidence"),
        F.substring(X.strip(X.squash("text")), 1, 300).alias("text"),
    )


def hand_labels(messages: DataFrame) -> DataFrame:
    """Verdict rows as they would be appended by hand: overwrites, synthetic rows, noise."""
    seq = F.col("seq")
    rule = F.when(seq % 3 == 0, "R10").when(seq % 3 == 1, "R11").otherwise("R13")
    prefix = F.when(seq % 3 == 0, "criterion:").when(seq % 3 == 1, "scope:").otherwise("prov:")
    return messages.where(seq % 4 < 2).select(
        seq.alias("ord"),
        "sid",
        rule.alias("rule"),
        F.concat(prefix, X.sha12("text")).alias("fire_key"),
        F.when(seq % 8 == 0, "unlabelled").when(seq % 5 < 3, "applies").otherwise("does-not-apply").alias("verdict"),
        (seq % 13 == 0).alias("synthetic"),
        F.when(seq % 2 == 0, "manual-review").otherwise("verdict-reply").alias("source"),
    )


def normalise_log(log: DataFrame) -> DataFrame:
    """Rewrite attempts: one row per API error fact, older rows lack the time split."""
    seq = F.col("seq")
    split = seq % 4 != 0
    return log.where("kind = 'api_error'").select(
        "sid", "ts", "seq",
        F.when(seq % 5 == 0, "skip").when(seq % 5 == 1, "timeout").otherwise("restated").alias("status"),
        F.when(seq % 11 == 0, F.lit(0.0)).otherwise(F.col("elapsed_ms")).alias("elapsed_ms"),
        F.when(split, F.round(F.col("elapsed_ms") / 4, 3)).alias("setup_ms"),
        F.when(split, F.round(F.col("elapsed_ms") / 2, 3)).alias("request_ms"),
        template_text(seq, F.lit("7")).alias("prompt"),
        F.when(seq % 5 > 1, F.concat(F.lit("restated: "), template_text(seq, F.lit("7")))).otherwise("").alias("restatement"),
    )


# ---- capture snapshots ------------------------------------------------------------------------

def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots derived from ``conversations``: capture n holds all texts up to turn n.

    A session is a whole conversation. Its last snapshot is the conversation's text, so a snapshot is as long as the
    session, here as in a real log.
    Columns: sid, count, event, captured_us, content (NULL when the file is missing).
    """
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text",
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.row_number().over(w)
    conv, turn = F.col("conv_id"), F.col("turn")
    names = F.array(*[F.lit(e) for e in ("PreCompact", "PostCompact", "Stop", "PostToolUse", "SessionStart")])
    body = F.array_join(F.collect_list("text").over(so_far), "\n")
    altered = (conv % 7 == 0) & (F.col("n") == 3)
    content = (
        F.when((conv % 13 == 0) & (F.col("n") == 2), None)
        .when((conv % 11 == 0) & (F.col("n") == 2), F.lit(""))
        .when(altered, F.concat(F.lit("~"), F.col("body")))
        .otherwise(F.col("body"))
    )
    rows = turns.select("*", nth.alias("n"), body.alias("body"))
    return rows.select(
        conv.cast("string").alias("sid"),
        (turn + 1).alias("count"),
        F.element_at(names, ((conv + turn) % 5 + 1).cast("int")).alias("event"),
        (F.lit(EPOCH_US) + conv * 60_000_000 + turn * 1_000_000).alias("captured_us"),
        F.encode(content, "UTF-8").alias("content"),
    )


# ---- raw transcript lines ---------------------------------------------------------------------

def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as JSON lines in the raw file shape: sid, file_size, path, place, line.

    Every session has a large file and a smaller partial copy; lines that carry no fact (platform
    notices, interrupt notices, own injections, broken lines) are mixed in.
    """
    f = session_log(spark, sf_dir)
    seq, ts, ref, text = F.col("seq"), F.col("ts"), F.col("ref"), F.coalesce("text", F.lit(""))
    bare = F.substring(F.coalesce(ref, F.lit("")), 2, 20)

    def obj(**fields: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))

    def user(suffix: str, **fields: Column) -> Column:
        return obj(type=F.lit("user"), uuid=F.concat(F.lit("u"), seq, F.lit(suffix)), timestamp=ts, **fields)

    def assistant(suffix: str, blocks: Column, **fields: Column) -> Column:
        return obj(
            type=F.lit("assistant"), uuid=F.concat(F.lit("u"), seq, F.lit(suffix)), timestamp=ts,
            message=F.struct(blocks.alias("content")), **fields)

    def said(t: Column) -> Column:
        return F.struct(t.alias("content"))

    def tool_use(id_: Column, name: str, **inputs: Column) -> Column:
        given = F.struct(*[c.alias(n) for n, c in inputs.items()]) if inputs else F.struct(F.lit(1).alias("n"))
        return F.array(F.struct(
            F.lit("tool_use").alias("type"), id_.alias("id"), F.lit(name).alias("name"), given.alias("input")))

    def result(id_: Column, body: Column, error: Column) -> Column:
        return F.struct(F.array(F.struct(
            F.lit("tool_result").alias("type"), id_.alias("tool_use_id"),
            F.when(error, True).alias("is_error"), body.alias("content"))).alias("content"))

    no = F.lit(False)
    note = F.concat(
        F.lit(V.NOTIFICATION_TAG),
        F.when(ref.isNotNull(), F.concat(
            F.lit("<task-id>bg"), bare, F.lit("</task-id><tool-use-id>"), ref, F.lit("</tool-use-id>"))).otherwise(""),
        F.lit("</task-notification>"))
    blocks_text = F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    message_lines = F.array(
        F.when(seq % 37 == 0, user("m", isMeta=F.lit(True), message=said(F.lit("platform notice")))),
        F.when(seq % 41 == 0, user("i", message=said(F.lit("[Request interrupted by user]")))),
        F.when(seq % 43 == 0, user("s", message=said(F.lit("<system-reminder>x</system-reminder>")))),
        F.when(seq % 47 == 0, F.lit('{"type":"user","uuid":')),
        F.when(seq % 53 == 0, obj(
            type=F.lit("attachment"), uuid=F.concat(F.lit("u"), seq, F.lit("h")), timestamp=ts,
            attachment=F.struct(F.lit(V.OWN_ATTACHMENTS[0]).alias("type"), F.lit("x").alias("prompt")))),
        F.when(seq % 5 == 0, obj(
            type=F.lit("attachment"), uuid=F.concat(F.lit("u"), seq, F.lit("p")), timestamp=ts,
            attachment=F.struct(
                F.lit("command_permissions").alias("type"),
                F.array(F.lit("Read"), F.concat(F.lit("T"), seq % 7)).alias("allowedTools")))),
        F.when(seq % 3 == 0, user("", message=blocks_text, cwd=F.lit("/work")))
        .otherwise(user("", message=said(text), cwd=F.lit("/work"))),
    )
    stop_id = F.concat(F.lit("S"), seq)
    lines = (
        F.when(F.col("kind") == "message", message_lines)
        .when(F.col("kind") == "queue", F.array(obj(
            type=F.lit("queue-operation"), timestamp=ts, operation=F.col("op"), content=text)))
        .when(F.col("kind") == "launch", F.array(
            assistant("t", F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))),
            assistant("", tool_use(ref, "Bash", run_in_background=F.lit(True))),
            user("r", message=result(ref, F.concat(
                F.lit("Command running in background with ID: bg"), seq, F.lit(". Output follows.")), no))))
        .when(F.col("kind") == "question", F.array(assistant("", tool_use(ref, "AskUserQuestion"))))
        .when(F.col("kind") == "notified", F.array(
            F.when(seq % 2 == 0, obj(
                type=F.lit("attachment"), uuid=F.concat(F.lit("u"), seq), timestamp=ts,
                attachment=F.struct(F.lit("queued_command").alias("type"), note.alias("prompt"), ts.alias("timestamp"))))
            .otherwise(user("", message=said(note)))))
        .when(F.col("kind").isin("ended", "stop_failed"), F.array(
            assistant("", tool_use(stop_id, "TaskStop", task_id=F.when(ref.isNotNull(), F.concat(F.lit("bg"), bare)).otherwise(""))),
            user("r", message=result(stop_id, F.lit("stopped"), F.col("kind") == "stop_failed"))))
        .when(F.col("kind") == "denial", F.array(
            F.when(ref.isNull(), user("", toolDenialKind=F.lit("user-rejected"), message=said(F.lit(""))))
            .when(F.col("op") == "clarify", user(
                "", toolDenialKind=F.lit("user-rejected"), userFeedback=F.lit("say more"),
                message=result(ref, F.lit("denied"), F.lit(True))))
            .otherwise(user(
                "", toolDenialKind=F.lit("user-rejected"), message=result(ref, F.lit("denied"), F.lit(True))))))
        .otherwise(F.array(obj(
            type=F.lit("assistant"), uuid=F.concat(F.lit("u"), seq), timestamp=ts, apiErrorStatus=F.lit(500),
            message=F.struct(F.array().cast("array<struct<type:string>>").alias("content")))))
    )
    copies = F.when(seq % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        f.select("sid", "seq", F.posexplode(F.array_compact(lines)).alias("pos", "line"), copies.alias("copies"))
        .select("sid", "seq", "pos", "line", F.explode("copies").alias("copy"))
        .select(
            "sid", F.when(F.col("copy") == 0, 2000).otherwise(1000).cast("long").alias("file_size"),
            F.concat("sid", F.lit(".epoch"), F.col("copy").cast("string"), F.lit(".jsonl")).alias("path"),
            (F.col("seq") * 10 + F.col("pos")).alias("place"), "line",
        )
    )


def parsed_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        transcript_lines(spark, sf_dir)
        .select("sid", "file_size", "path", "place", F.try_parse_json("line").alias("v"))
        .where("v IS NOT NULL")
    )


# ---- capture files and event logs -------------------------------------------------------------

def conversation(sid: str = "sid") -> Column:
    return F.expr(f"cast(split({sid}, '-')[0] as bigint)")


def capture_files(captures: DataFrame) -> DataFrame:
    """The corpus as a file listing: path, length, modified_us (snapshots, event logs, strays)."""
    root = F.lit("corpus/")
    snaps = captures.where("content IS NOT NULL").select(
        F.concat(root, "sid", F.lit("."), F.col("count").cast("string"), F.lit(".transcript.jsonl")).alias("path"),
        F.octet_length("content").cast("long").alias("length"), F.col("captured_us").alias("modified_us"))
    logs = captures.where(conversation() % 3 != 0).groupBy("sid").agg(
        (F.count("*") * 100).alias("length"), F.max("captured_us").alias("modified_us")
    ).select(F.concat(root, "sid", F.lit(".events.jsonl")).alias("path"), "length", "modified_us")
    strays = captures.where("count = 1").select(
        F.concat(root, "sid", F.lit(".count")).alias("path"), F.lit(2).cast("long").alias("length"),
        F.col("captured_us").alias("modified_us"))
    return snaps.unionByName(logs).unionByName(strays)


def capture_event_rows(captures: DataFrame) -> DataFrame:
    """Event records; one capture in six was never recorded."""
    return captures.where((conversation() + F.col("count")) % 6 != 0).select(
        "sid", "count", "event", "captured_us",
        F.concat("sid", F.lit("."), F.col("count").cast("string"), F.lit(".transcript.jsonl")).alias("snapshot"),
        F.octet_length("content").alias("snapshot_bytes"))


def capture_lengths(captures: DataFrame) -> DataFrame:
    """Snapshot files a file source reports; empty ones only where no event row tells of them."""
    seen = (F.octet_length("content") > 0) | ((conversation() + F.col("count")) % 6 == 0)
    return captures.where("content IS NOT NULL").where(seen).select("sid", "count", F.octet_length("content").alias("length"))


def payloads(captures: DataFrame) -> DataFrame:
    """Compaction payloads as the event records carry them."""
    n = conversation() + F.col("count")
    return captures.where("event IN ('PreCompact', 'PostCompact')").select(
        "sid", "count", F.to_json(F.struct(
            F.when(n % 2 == 0, "manual").alias("trigger"),
            F.when(n % 3 == 0, "keep names").when(n % 3 == 1, "").alias("custom_instructions"),
            F.when(F.col("event") == "PostCompact", F.concat(F.lit("summary of "), F.col("count").cast("string"))).alias("compact_summary"),
        )).alias("payload"))


def event_lines(captures: DataFrame) -> DataFrame:
    """Event records as JSON lines, with repeats, a non-integer count, blank and broken lines."""
    n = conversation() + F.col("count")
    record = F.to_json(F.struct(
        F.col("sid").alias("session_id"), "count", "event",
        X.iso("captured_us").alias("captured_at"),
        F.octet_length("content").alias("snapshot_bytes"),
        F.struct((n % 4).alias("n")).alias("payload")))
    again = F.to_json(F.struct(F.col("sid").alias("session_id"), "count", F.lit("Repeat").alias("event")))
    lines = F.array_compact(F.array(
        record, F.when(n % 4 == 0, again), F.when(n % 5 == 0, ""), F.when(n % 7 == 0, '{"count": 3, "sess'),
        F.when(n % 9 == 0, '{"session_id": "x", "count": "seven"}')))
    return captures.select("sid", "count", F.posexplode(lines).alias("pos", "line"))


def event_logs(captures: DataFrame) -> DataFrame:
    """Each session's event log as bytes."""
    return captures.groupBy("sid").agg(F.encode(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("count", "event"))),
        lambda r: F.concat(r["count"].cast("string"), F.lit(":"), r["event"], F.lit("\n"))), ""), "UTF-8").alias("content"))


def event_log_copies(logs: DataFrame) -> DataFrame:
    """Copies of the event logs: most equal, some shorter, some damaged, some never made."""
    conv = conversation()
    return logs.where(conv % 19 != 7).select("sid", F.when(
        conv % 8 == 1, F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 2)
    ).when(conv % 17 == 3, F.encode(F.lit("0:Other\n"), "UTF-8")).otherwise(F.col("content")).alias("content"))


def compaction_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose content is JSON lines, some with compaction records naming earlier lines."""
    turns = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    plain = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("c"), conv, F.lit("-"), turn).alias("uuid")))
    named = F.array(*[F.concat(F.lit("c"), conv, F.lit("-"), turn - d) for d in (1, 2, 9)])
    compact = F.to_json(F.struct(
        F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"),
        F.struct(
            (conv * 10 + turn).alias("preTokens"), turn.alias("postTokens"), conv.alias("cumulativeDroppedTokens"),
            F.when(turn % 2 == 0, turn * 5).alias("durationMs"),
            F.struct(named.alias("allUuids")).alias("preservedMessages")).alias("compactMetadata")))
    line = F.when((conv + turn) % 3 == 2, compact).otherwise(plain)
    rows = turns.select(
        conv.cast("string").alias("sid"),
        F.struct("turn", F.concat(line, F.lit("\n")).alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "")
    return rows.groupBy("sid").agg(F.encode(body, "UTF-8").alias("content")).select(
        "sid", F.lit(1).cast("long").alias("count"), F.lit("Stop").alias("event"),
        F.lit(EPOCH_US).alias("captured_us"), "content")
