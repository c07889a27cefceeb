"""One SQL statement per registered query that SQL can express."""

from __future__ import annotations

import json

from turnscope.functions import text as X
from turnscope.functions import vocab as V
from turnscope.oracle.base import (
    ANY_SIGNAL, HUMAN_OP, SIGNAL_LIST, SIGNAL_VALUES, action_case, capture_query,
    lit, matches, mid, query, refs, sha12, squash, template, tokens,
)
from turnscope.sources import catalogue as C
from turnscope.sources.views import EPOCH_US

FIRE = "sid, idx, rule, key, why, detail, array_to_string(subject, ' ') AS subject"
COPIES = "CASE WHEN seq % 10 = 0 THEN 2 ELSE 1 END"
USERS = """CASE kind WHEN 'message' THEN 1 + (seq % 37 = 0)::INT + (seq % 41 = 0)::INT + (seq % 43 = 0)::INT
  WHEN 'launch' THEN 1 WHEN 'notified' THEN seq % 2 WHEN 'ended' THEN 1 WHEN 'stop_failed' THEN 1 WHEN 'denial' THEN 1 ELSE 0 END"""
ATTACHED = """CASE kind WHEN 'message' THEN (seq % 53 = 0)::INT + (seq % 5 = 0)::INT WHEN 'notified' THEN 1 - seq % 2 ELSE 0 END"""
KEPT_ATTACHED = "CASE kind WHEN 'message' THEN (seq % 5 = 0)::INT WHEN 'notified' THEN 1 - seq % 2 ELSE 0 END"
ASSISTANT = "CASE kind WHEN 'launch' THEN 2 WHEN 'question' THEN 1 WHEN 'ended' THEN 1 WHEN 'stop_failed' THEN 1 WHEN 'api_error' THEN 1 ELSE 0 END"
QUEUED = "(kind = 'queue')::INT"


def line_counts(copies: str, attached: str) -> str:
    return query(f"""
SELECT type, CAST(sum(n * {copies}) AS BIGINT) AS lines FROM (
  SELECT seq, 'user' AS type, {USERS} AS n FROM facts UNION ALL SELECT seq, 'attachment', {attached} FROM facts
  UNION ALL SELECT seq, 'assistant', {ASSISTANT} FROM facts UNION ALL SELECT seq, 'queue-operation', {QUEUED} FROM facts)
GROUP BY type""")


def runs(view: str, names: str, where: str = "true") -> str:
    return query(f"""
SELECT sid, {names}, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS messages
FROM {view} WHERE {where} GROUP BY ALL""")


AUTO10 = f"""
auto10 AS (SELECT f.sid, f.idx, f.rule, f.key, EXISTS (SELECT 1 FROM msgs o LEFT JOIN ratios r ON r.a = m.text AND r.b = o.text
    WHERE o.sid = f.sid AND o.idx <> f.idx AND {matches('o.text', V.NO_CRITERION)} AND (o.text = m.text OR r.ratio >= 0.7)) AS auto_label
  FROM fires1 f JOIN msgs m ON m.sid = f.sid AND m.idx = f.idx WHERE f.rule = 'R10')"""
LABELLED = AUTO10 + """,
auto_labels AS (SELECT sid, idx, rule, key, auto_label FROM auto4 UNION ALL SELECT * FROM auto10
  UNION ALL SELECT sid, idx, rule, key, true FROM fires1 WHERE rule = 'R12'
  UNION ALL SELECT DISTINCT sid, idx, rule, key, true FROM fires1 WHERE rule = 'R07' AND contains(detail, 'negation differs')
  UNION ALL SELECT sid, idx, rule, key, true FROM corrections),
labelled AS (SELECT f.sid, f.idx, f.rule, f.key, f.why, f.detail, b.basis, h.hand, coalesce(h.hand, a.auto_label) AS label
  FROM fires1 f JOIN basis b USING (rule) LEFT JOIN auto_labels a USING (sid, idx, rule, key) LEFT JOIN hand h USING (rule, key))"""
PRECISION = LABELLED + """,
counts AS (SELECT b.rule, b.basis, count(l.sid) AS fires, count(*) FILTER (l.label) AS confirmed,
    count(*) FILTER (NOT l.label) AS refuted, count(l.sid) FILTER (l.label IS NULL) AS unknown,
    count(DISTINCT l.sid) AS sessions, count(l.hand) AS hand_labelled
  FROM basis b LEFT JOIN labelled l USING (rule) GROUP BY b.rule, b.basis),
results AS (SELECT *, CASE WHEN judged THEN round_even(confirmed / nullif(fires, 0), 3) END AS precision,
    CASE WHEN judged THEN round_even(confirmed / nullif(confirmed + refuted, 0), 3) END AS precision_labelled
  FROM (SELECT *, basis NOT IN ('tautological', 'manual', 'none') OR hand_labelled > 0 AS judged FROM counts))"""
REFRESHED = PRECISION + """,
refreshed AS (SELECT c.rule, c.action, c.suspended, c.suspended_reason, c.template,
    CASE WHEN n THEN r.precision ELSE c.precision END AS precision, CASE WHEN n THEN r.basis ELSE c.basis END AS basis,
    CASE WHEN n THEN r.refuted ELSE c.refuted END AS refuted, CASE WHEN n THEN r.hand_labelled ELSE c.hand_labelled END AS hand_labelled
  FROM (SELECT *, true AS n FROM catalogue) c JOIN results r USING (rule))"""
ROUTED = f"""
acted AS (SELECT *, {action_case()} AS runtime FROM catalogue),
seen AS (SELECT f.*, m.ts, m.seq, a.runtime, a.template, f.idx = min(f.idx) OVER (PARTITION BY f.sid, f.rule, f.key) AS first_
  FROM fires f JOIN msgs m USING (sid, idx) JOIN acted a USING (rule)),
flagged AS (SELECT *, runtime NOT IN ('augment', 'log') AND first_ AND template IS NOT NULL AS eligible FROM seen),
counted AS (SELECT *, coalesce(sum(eligible::INT) OVER (PARTITION BY sid ORDER BY ts, seq, rule, key
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS asked FROM flagged),
routed AS (SELECT sid, ts, seq, idx, rule, key, why, detail, template, runtime AS action,
  CASE WHEN runtime = 'augment' THEN template IS NOT NULL ELSE eligible AND asked < {V.MAX_ASKS_PER_SESSION} END AS surfaced,
  runtime <> 'augment' AND NOT first_ AS deduped,
  CASE WHEN runtime = 'augment' OR NOT first_ THEN NULL WHEN runtime = 'log' THEN 'precision-floor'
    WHEN asked >= {V.MAX_ASKS_PER_SESSION} THEN 'ask-budget' WHEN template IS NULL THEN 'no-template' END AS suppressed,
  runtime <> 'augment' AND eligible AND asked < {V.MAX_ASKS_PER_SESSION} AS pending_verdict FROM counted)"""
RENDERED = ROUTED + """,
rendered AS (SELECT *, replace(replace(replace(template, '{cwd}', '.'), '{why}', why), '{detail}', detail) AS text
  FROM routed WHERE surfaced)"""
FIRE_LOG = ROUTED + """,
fire_log AS (SELECT r.ts, r.sid, r.idx, r.rule, r.key, r.action, r.surfaced, 3 AS phase, r.why, substr(r.detail, 1, 300) AS detail,
  r.deduped, r.suppressed, r.pending_verdict, m.elapsed_ms FROM routed r JOIN msgs m USING (sid, idx))"""
LOG_COLUMNS = "ts, sid, idx, rule, key, action, surfaced, phase, why, detail, deduped, suppressed, pending_verdict, elapsed_ms"


def verdict(x: str) -> str:
    """A reply's verdict: the longest leading phrase after filler words."""
    phrases = X.PHRASE_PATTERN.replace("'", "''")
    body = f"regexp_replace(lower(trim({x})), {lit(V.VERDICT_LEAD)}, '')"
    lead = f"regexp_extract({body}, '^({phrases})\\b', 1)"
    return (f"CASE WHEN length(trim({x})) = 0 OR length(trim({x})) > {V.VERDICT_MAX_CHARS} OR {lead} = '' THEN 'unlabelled' "
            f"WHEN {lead} IN ({', '.join(lit(p) for p in V.AFFIRM)}) THEN 'applies' ELSE 'does-not-apply' END")


PENDING = ROUTED + f""",
asks AS (SELECT *, count(*) OVER (PARTITION BY sid, idx) AS n FROM routed WHERE pending_verdict),
settled AS (SELECT a.sid, a.idx AS asked_idx, a.rule, a.key, a.action, CASE WHEN n = 1 THEN {verdict('m.text')} ELSE 'unlabelled' END AS verdict,
  CASE WHEN n = 1 THEN substr({squash('m.text')}, 1, 200) ELSE n || ' fires pending; reply cannot be attributed' END AS note
  FROM asks a JOIN msgs m ON m.sid = a.sid AND m.idx = a.idx + 1)"""
SIGNALS = f"""
signals AS (SELECT sid, idx, text, signal FROM (SELECT sid, idx, text, unnest({SIGNAL_LIST}) AS signal FROM msgs) WHERE signal IS NOT NULL),
per_message AS (SELECT sid, idx, list_sort(list(DISTINCT rule)) AS rules FROM fires1 WHERE rule <> 'R13' GROUP BY ALL),
matched AS (SELECT s.*, coalesce(p.rules, []) AS rules, len(list_filter(coalesce(p.rules, []), lambda r: r NOT IN ('R03', 'R05'))) > 0 AS real
  FROM signals s LEFT JOIN per_message p USING (sid, idx))"""
ACTIVE = """
active AS (SELECT DISTINCT sid, idx, rule FROM fires WHERE rule NOT IN ('R01', 'R04', 'R12', 'R13')
  UNION ALL SELECT DISTINCT sid, idx, 'R04' FROM asof_questions WHERE outcome <> 'answered'
  UNION ALL SELECT DISTINCT sid, idx, 'R12' FROM lost
  UNION ALL SELECT DISTINCT m.sid, m.idx, 'R01' FROM open_drafts d JOIN msgs m ON m.sid = d.sid AND m.idx >= d.upto
    AND (d.hit IS NULL OR m.idx < d.hit))"""
BACK = ACTIVE + """,
located AS (SELECT k.key, k.sid, k.kind, min(m.idx) AS idx FROM markers k LEFT JOIN msgs m ON m.key = k.key GROUP BY ALL),
back AS (SELECT l.key, l.sid, l.kind, l.idx AS at_idx, b AS back, l.idx - b AS idx FROM located l, (VALUES (1), (2), (3)) AS v(b)
  WHERE l.idx - b >= 1)"""
AHEAD = """
marked AS (SELECT m.sid, m.idx, m.key IN (SELECT key FROM markers) AS marker FROM msgs m),
ahead AS (SELECT m.sid, m.idx, d.*, k, EXISTS (SELECT 1 FROM marked x WHERE x.sid = m.sid AND x.idx BETWEEN m.idx + 1 AND m.idx + k AND x.marker) AS followed
  FROM msgs m JOIN (SELECT * EXCLUDE (sid) FROM directive_last) d USING (key), (VALUES (1), (2), (3)) AS v(k)
  WHERE d.is_directive AND d.strength IN ('direct', 'weakened')),
rates AS (SELECT k, strength, count(*) AS total, count(*) FILTER (followed) AS hits, count(*) FILTER (followed) / count(*) AS rate FROM ahead GROUP BY ALL),
forms AS (SELECT sid, idx, k, text, followed, unnest(CASE WHEN len(f) = 0 THEN ['(unflagged)'] ELSE f END) AS form FROM (
  SELECT *, list_filter([CASE WHEN hedged THEN 'hedged' END, CASE WHEN understated THEN 'understated' END,
    CASE WHEN interrogative THEN 'interrogative' END, CASE WHEN optative THEN 'optative' END], lambda x: x IS NOT NULL) AS f
  FROM ahead WHERE strength = 'weakened' AND k = 3))"""
JUDGED = f"judged AS (SELECT *, desync AS verdict, {ANY_SIGNAL} AS regex FROM desync_last)"
NORMALISE = f"""
norm AS (SELECT sid, ts, seq, CASE seq % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'timeout' ELSE 'restated' END AS status,
  CASE WHEN seq % 11 = 0 THEN 0.0 ELSE elapsed_ms END AS elapsed_ms,
  CASE WHEN seq % 4 <> 0 THEN round(elapsed_ms / 4, 3) END AS setup_ms, CASE WHEN seq % 4 <> 0 THEN round(elapsed_ms / 2, 3) END AS request_ms,
  {template('seq', "'7'")} AS prompt, CASE WHEN seq % 5 > 1 THEN 'restated: ' || {template('seq', "'7'")} ELSE '' END AS restatement
  FROM facts WHERE kind = 'api_error')"""
PREVIOUS = """
previous AS (SELECT m.sid, m.idx, m.key, m.text, coalesce(arg_max(f.text, f.ts || printf('%015d', f.seq)), '') AS previous
  FROM msgs m LEFT JOIN facts f ON f.sid = m.sid AND f.kind = 'launch' AND (f.ts, f.seq) < (m.ts, m.seq) GROUP BY ALL)"""
def with_(parts: str, select: str) -> str:
    return query(", ").rstrip().rstrip(",") + ",\n" + parts.strip() + "\n" + select.strip()


def bands(values: str) -> str:
    return f"""
SELECT band, max(n) AS n, max(value) FILTER (r = n // 2) AS median, max(value) FILTER (r = floor(n * 0.95::DOUBLE)) AS p95, max(value) AS max
FROM (SELECT band, value, row_number() OVER (PARTITION BY band ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY band) AS n
  FROM ({values}) WHERE value IS NOT NULL) GROUP BY band"""


CATALOGUE_COLUMNS = "rule, action, suspended, precision, basis, refuted, hand_labelled, template"
CONV = "CAST(split_part(sid, '-', 1) AS BIGINT)"
FILES = f"""
files AS (SELECT 'corpus/' || sid || '.' || count || '.transcript.jsonl' AS path, bytes AS length, captured_us AS modified_us, sid FROM listing WHERE exists_
  UNION ALL SELECT 'corpus/' || sid || '.events.jsonl', count(*) * 100, max(captured_us), sid FROM listing WHERE {CONV} % 3 <> 0 GROUP BY sid
  UNION ALL SELECT 'corpus/' || sid || '.count', 2, captured_us, sid FROM listing WHERE count = 1)"""
TAMPERED = f"""
tampered AS (SELECT sid, count, base, base_bytes, content, exists_, CASE WHEN {CONV} % 10 = 1 AND count = 1 THEN '0' || substr(sha256, 2) ELSE sha256 END AS sha256, sha256 AS true_sha,
  CASE WHEN {CONV} % 10 = 2 AND count = 2 THEN 'odd' ELSE source END AS source, bytes AS true_bytes,
  CASE WHEN {CONV} % 10 = 3 AND count = 1 THEN bytes + 1000000 ELSE bytes END AS bytes
  FROM (SELECT *, content IS NOT NULL AS exists_ FROM index_)),
checks AS (SELECT sid, count, source, CASE source WHEN 'epoch' THEN CASE WHEN bytes > base_bytes THEN 'offset-past-end'
    WHEN sha256 <> true_sha THEN 'prefix-hash-mismatch' END
  WHEN 'empty' THEN CASE WHEN sha256 <> sha256('') THEN 'hash-mismatch' END
  WHEN 'inflight' THEN CASE WHEN sha256 <> true_sha THEN 'hash-mismatch' END
  WHEN 'full' THEN CASE WHEN sha256 <> true_sha THEN 'hash-mismatch' END ELSE 'unknown-source' END AS failure
  FROM tampered WHERE source <> 'missing')"""
STALE = f"""
part AS (SELECT * FROM index_ WHERE NOT ({CONV} % 5 = 0 AND count >= 4)),
logs AS (SELECT sid, string_agg(count || ':' || event || chr(10), '' ORDER BY count) AS theirs FROM listing GROUP BY sid),
copies AS (SELECT sid, theirs, CASE WHEN {CONV} % 19 = 7 THEN NULL WHEN {CONV} % 8 = 1 THEN left(theirs, length(theirs) - 2)
  WHEN {CONV} % 17 = 3 THEN '0:Other' || chr(10) ELSE theirs END AS mine FROM logs),
compared AS (SELECT sid, CASE WHEN mine IS NULL THEN 'not-copied' WHEN mine = theirs THEN 'same' WHEN starts_with(theirs, mine) THEN 'behind'
  ELSE 'diverges' END AS events_copy FROM copies),
extra AS (SELECT sid, count(*) AS unindexed FROM listing l WHERE exists_ AND NOT EXISTS (SELECT 1 FROM part p WHERE p.sid = l.sid AND p.count = l.count) GROUP BY sid),
stale AS (SELECT sid, coalesce(unindexed, 0) AS unindexed, events_copy, coalesce(unindexed, 0) > 0 OR events_copy = 'behind' AS stale,
  events_copy IN ('diverges', 'not-copied') AS failed FROM (SELECT DISTINCT sid FROM part) LEFT JOIN extra USING (sid) LEFT JOIN compared USING (sid))"""


def captures_with(parts: str, select: str) -> str:
    return capture_query(", ").rstrip().rstrip(",") + ",\n" + parts.strip() + "\n" + select.strip()


INDEX_ROWS = capture_query("""
SELECT sid, count, event, bytes, epoch, in_flight, is_base, source, sha256,
  CASE WHEN source = 'epoch' THEN length(content) - length(replace(content, chr(10), '')) ELSE lines END AS lines, source = 'full' AS prefix_mismatch FROM index_""")


def conversations_json() -> str:
    """Compaction records written and read without JSON: the rows they must yield."""
    sid = "CAST(conv_id AS VARCHAR)"
    return f"""
WITH l AS (SELECT {sid} AS sid, conv_id, turn, row_number() OVER (PARTITION BY {sid} ORDER BY turn) - 1 AS line_index,
    (conv_id + turn) % 3 = 2 AS compact FROM conversations),
u AS (SELECT l.*, d, 'c' || conv_id || '-' || (turn - d) AS u FROM l, (VALUES (1), (2), (9)) AS v(d) WHERE compact),
p AS (SELECT sid, 'c' || conv_id || '-' || turn AS u FROM l WHERE NOT compact)
SELECT u.sid, line_index, conv_id * 10 + turn AS pre_tokens, turn AS post_tokens, conv_id AS dropped_tokens,
  CASE WHEN turn % 2 = 0 THEN turn * 5 END AS duration_ms, string_agg(u.u, ',' ORDER BY u.u) AS preserved,
  count(p.u) AS resolved, count(*) FILTER (p.u IS NULL) AS unresolved
FROM u LEFT JOIN p ON p.sid = u.sid AND p.u = u.u GROUP BY ALL"""


def sources() -> dict[str, str]:
    return {
        "scan_capture_events": captures_with("x AS (SELECT 1)", f"""
SELECT sid, count, event, strftime(make_timestamp(captured_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS captured_at,
  CASE WHEN exists_ THEN bytes END AS snapshot_bytes, '{{"n":' || (({CONV} + count) % 4) || '}}' AS payload FROM listing"""),
        "scan_transcript_lines": line_counts(COPIES, ATTACHED),
        "scan_snapshots": capture_query("SELECT sid, count, sid || '.' || count || '.transcript.jsonl' AS snapshot, bytes FROM listing WHERE exists_"),
        "discover_sessions": captures_with(FILES, "SELECT DISTINCT sid FROM files WHERE path LIKE '%.events.jsonl' OR path LIKE '%.transcript.jsonl'"),
        "capture_catalog": capture_query(f"""
SELECT sid, count, CASE WHEN ({CONV} + count) % 6 <> 0 THEN event END AS event, sid || '.' || count || '.transcript.jsonl' AS snapshot,
  bytes, exists_ AS exists FROM listing WHERE exists_ OR ({CONV} + count) % 6 <> 0"""),
        "scan_catalogue": with_(REFRESHED, f"SELECT {CATALOGUE_COLUMNS} FROM refreshed"),
        "sink_catalogue_metrics": with_(REFRESHED, f"SELECT {CATALOGUE_COLUMNS} FROM refreshed"),
        "sink_append_log": with_(FIRE_LOG, f"SELECT {LOG_COLUMNS} FROM fire_log"),
    }


def shape() -> dict[str, str]:
    bg = "'bg' || substr(ref, 2)"
    return {
        "ordered_events": query(f"""
SELECT sid, CAST(sum({USERS} + {ATTACHED} + {ASSISTANT} + {QUEUED}) AS BIGINT) AS lines,
  CAST(sum({USERS} + {ATTACHED} + {ASSISTANT} + {QUEUED}) AS BIGINT) AS last_seq, max(ts) AS last_ts FROM facts GROUP BY sid"""),
        "human_messages": query("SELECT sid, ts, text, CASE WHEN true THEN '/work' END AS cwd FROM msgs"),
        "tool_calls": query("""
SELECT sid, ts, ref AS id, 'Bash' AS name, 'launch' AS kind, NULL::VARCHAR AS task_id FROM facts WHERE kind = 'launch'
UNION ALL SELECT sid, ts, ref, 'AskUserQuestion', 'question', NULL FROM facts WHERE kind = 'question'
UNION ALL SELECT sid, ts, 'S' || seq, 'TaskStop', CASE WHEN ref IS NULL THEN 'other' ELSE 'stop' END,
  CASE WHEN ref IS NULL THEN '' ELSE 'bg' || substr(ref, 2) END FROM facts WHERE kind IN ('ended', 'stop_failed')"""),
        "tool_results": query("""
SELECT sid, ts, ref AS tool_use_id, false AS is_error, 'Command running in background with ID: bg' || seq || '. Output follows.' AS body
FROM facts WHERE kind = 'launch'
UNION ALL SELECT sid, ts, 'S' || seq, kind = 'stop_failed', 'stopped' FROM facts WHERE kind IN ('ended', 'stop_failed')
UNION ALL SELECT sid, ts, ref, true, 'denied' FROM facts WHERE kind = 'denial' AND ref IS NOT NULL"""),
        "queue_operations": query(f"SELECT sid, ts, op, text AS content, {HUMAN_OP} AS human FROM facts WHERE kind = 'queue'"),
        "task_notifications": query(f"SELECT sid, ts, ref AS tool_use_id, {bg} AS task_id FROM facts WHERE kind = 'notified'"),
        "task_identity": query(f"SELECT DISTINCT sid, {bg} AS task_id, ref AS launch FROM facts WHERE kind = 'launch' OR (kind = 'notified' AND ref IS NOT NULL)"),
        "task_endings": query("SELECT sid, ts, ref AS launch FROM facts WHERE kind = 'ended' AND ref IS NOT NULL"),
        "questions_asof": runs("asof_questions", "question, outcome"),
        "denials": query("SELECT sid, ts, 'user-rejected' AS kind FROM facts WHERE kind = 'denial'"),
        "api_errors": query("SELECT sid, ts FROM facts WHERE kind = 'api_error'"),
        "self_injection_guard": line_counts("1", KEPT_ATTACHED),
        "allowed_tools": query("SELECT sid, 'Read,T' || (arg_max(seq, ts || printf('%015d', seq)) % 7) AS tools FROM msgs WHERE seq % 5 = 0 GROUP BY sid"),
        "message_keys": query(f"SELECT sid, idx, {mid('sid', 'idx')} AS id, key FROM msgs"),
        "message_tokens": f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, sha1(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
        "references_extracted": query("SELECT sid, idx, " + ", ".join(
            f"array_to_string({refs('text', p)}, '|') AS {n}" for n, p in
            (("urls", V.URL), ("paths", V.PATH), ("repos", V.REPO), ("endpoints", V.ENDPOINT))) + " FROM msgs"),
        "page_urls": f"SELECT page_id, unnest({refs(chr(39) + chr(39) + ' || url || chr(32) || html', V.URL)}) AS url FROM pages",
        "previous_turn": with_(PREVIOUS, "SELECT sid, idx, key, previous FROM previous"),
        "systematic_sample": query("""
SELECT sid, idx, pos FROM (SELECT sid, idx, row_number() OVER (ORDER BY sid, idx) - 1 AS pos, greatest(1, count(*) OVER () // 100) AS step FROM msgs)
WHERE pos % step = 0 AND pos // step < 100"""),
        "judgement_requests": with_(PREVIOUS, f"""
SELECT key, sid, idx, coalesce(nullif(previous, ''), {lit(V.FIRST_MESSAGE_PLACEHOLDER)}) AS previous, text AS message FROM previous"""),
        "uncached_requests": with_(PREVIOUS, f"""
SELECT key, sid, idx, coalesce(nullif(previous, ''), {lit(V.FIRST_MESSAGE_PLACEHOLDER)}) AS previous, text AS message
FROM previous WHERE key NOT IN (SELECT key FROM desync)"""),
        "transcript_facts": query("""
SELECT sid, kind, count(*) AS n FROM (
  SELECT sid, kind FROM facts WHERE kind IN ('message', 'queue', 'launch', 'question', 'notified', 'denial', 'api_error')
  UNION ALL SELECT sid, kind FROM facts WHERE kind = 'ended' AND ref IS NOT NULL
  UNION ALL SELECT sid, 'question_denial' FROM facts WHERE kind = 'denial' AND ref IS NOT NULL
  UNION ALL SELECT sid, 'assistant' FROM facts, (VALUES (1), (2)) AS v(i) WHERE kind IN ('launch', 'question', 'ended', 'stop_failed', 'api_error')
    AND (i = 1 OR kind = 'launch')) GROUP BY ALL"""),
    }


def state() -> dict[str, str]:
    return {
        "presend_counts": query("SELECT sid, idx, prior_messages, queue_ops, launches, api_errors, denials FROM presend"),
        "stale_tasks": runs("stale", "task"),
        "open_questions": runs("asof_questions", "question", "outcome <> 'answered'"),
        "retraction_candidates": query("""
SELECT sid, draft, idx, count(b) AS candidates FROM (
  SELECT d.*, s.b FROM (SELECT DISTINCT d.sid, a AS draft, upto AS idx FROM drafts d JOIN msgs m ON m.sid = d.sid AND m.idx = d.upto
    WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.sid = d.sid AND s.first_idx <= d.upto AND s.b = d.a)) d
  LEFT JOIN said s ON s.sid = d.sid AND s.first_idx <= d.idx AND 2.0 * least(length(s.b), length(d.draft)) / (length(s.b) + length(d.draft)) >= 0.55)
GROUP BY ALL"""),
        "unresolved_retractions": query("SELECT sid, seq, upto AS idx, a AS text FROM open_drafts"),
        "state_facts": query("SELECT sid, idx, fact, n FROM state_facts"),
    }


def rules() -> dict[str, str]:
    return {
        **{f"rule_{r}": query(f"SELECT {FIRE} FROM r{r[1:]}") for r in (
            "r01", "r02", "r03", "r04", "r05", "r06", "r07", "r08", "r10", "r11", "r12", "r13")},
        "near_dup_candidates": query("SELECT sid, idx, a, b FROM near"),
        "evaluate_rules": query(f"SELECT {FIRE} FROM fires"),
        "fires_first_cause": query(f"SELECT {FIRE} FROM fires1"),
    }


def rule_params() -> str:
    """Built-in values, where the catalogue has none of its own."""
    given = {r["id"]: r.get("params") or {} for r in json.loads(C.PACKAGED.read_text())["rules"]}
    rows = [(r, n, v if given.get(r, {}).get(n) is None else given[r][n]) for (r, n), v in V.DEFAULT_PARAMS.items()]
    return f"SELECT * FROM (VALUES {', '.join(f'({lit(r)}, {lit(n)}, {float(v)}::DOUBLE)' for r, n, v in rows)}) AS p(rule, name, value)"


def routing() -> dict[str, str]:
    return {
        "rule_params": rule_params(),
        "rule_actions": with_(REFRESHED, f"SELECT rule, {action_case()} AS runtime_action FROM refreshed"),
        "fire_routing": with_(ROUTED, "SELECT sid, idx, rule, key, action, surfaced, deduped, suppressed, pending_verdict FROM routed"),
        "render_injections": with_(RENDERED, "SELECT sid, idx, rule, key, text FROM rendered"),
        "turn_bundle": with_(RENDERED, """
SELECT sid, idx, string_agg(text, chr(10) ORDER BY rule, key) AS context, array_to_string(list_sort(list(DISTINCT rule)), ' ') AS fired,
  coalesce(array_to_string(list_sort(list(DISTINCT rule) FILTER (pending_verdict)), ' '), '') AS asked FROM rendered GROUP BY sid, idx"""),
        "fire_log": with_(FIRE_LOG, f"SELECT {LOG_COLUMNS} FROM fire_log"),
        "reply_verdicts": query(f"SELECT sid, idx, {verdict('text')} AS verdict FROM msgs"),
        "pending_resolution": with_(PENDING, "SELECT sid, asked_idx, rule, key, action, verdict, note FROM settled"),
    }


def labels() -> dict[str, str]:
    return {
        "labels_resolved": query("SELECT rule, key AS fire_key, hand AS applies FROM hand"),
        "labels_latest": query("SELECT rule, key AS fire_key, verdict FROM hand_latest"),
        "later_correction": query("SELECT * FROM corrections"),
        "label_r04": query("SELECT sid, idx, rule, key, auto_label FROM auto4"),
        "label_r07": query("SELECT sid, idx, key, CASE WHEN contains(detail, 'negation differs') THEN true END AS auto_label FROM r07"),
        "label_r10": with_(AUTO10, "SELECT sid, idx, rule, key, auto_label FROM auto10"),
        "label_r12": query("SELECT sid, idx, key, true AS auto_label FROM fires1 WHERE rule = 'R12'"),
        "labelled_fires": with_(LABELLED, "SELECT sid, idx, rule, key, basis, hand, label FROM labelled"),
        "precision_table": with_(PRECISION, """
SELECT rule, basis, fires, confirmed, refuted, unknown, sessions, hand_labelled, precision, precision_labelled FROM results"""),
        "review_queue": query("""
SELECT sid, idx, rule, key, why, detail FROM fires1 WHERE (rule, key) NOT IN (SELECT (rule, key) FROM hand)"""),
        "recent_fires": with_(FIRE_LOG, """
SELECT n.ts, n.sid, n.idx, n.rule, n.key, n.action, CASE WHEN h.verdict IS NULL AND c.template IS NULL THEN 'n/a' ELSE h.verdict END AS verdict,
  c.template IS NOT NULL AND h.verdict IS NULL AS todo, n.surfaced, n.deduped, n.suppressed
FROM (SELECT DISTINCT ON (rule, key) * FROM fire_log ORDER BY rule, key, ts DESC, sid DESC, idx DESC) n
  JOIN catalogue c USING (rule) LEFT JOIN hand_latest h USING (rule, key) ORDER BY n.ts DESC, n.sid DESC, n.rule DESC, n.key DESC LIMIT 20"""),
        "fire_list": with_(LABELLED, f"""
SELECT rule, n, CASE WHEN label THEN 'TP' WHEN NOT label THEN 'FP' ELSE '??' END AS mark, {mid('sid', 'idx')} AS message, key
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule ORDER BY sid, idx, key) AS INTEGER) AS n FROM labelled) WHERE n <= 25"""),
        "backtest_summary": query("SELECT count(DISTINCT sid) AS sessions, count(*) AS messages, (SELECT count(*) FROM hand) AS verdicts FROM msgs"),
    }


def coverage() -> dict[str, str]:
    return {
        "signal_matches": with_(SIGNALS, "SELECT sid, idx, signal FROM signals"),
        "coverage_table": with_(SIGNALS, f"""
SELECT s.signal, count(m.sid) AS messages, count(*) FILTER (m.real) AS real, count(*) FILTER (NOT m.real AND len(m.rules) > 0) AS blind_only,
  count(*) FILTER (NOT m.real AND len(m.rules) = 0) AS none, count(*) FILTER (m.real) / nullif(count(m.sid), 0) AS coverage
FROM (VALUES {SIGNAL_VALUES}) AS s(signal) LEFT JOIN matched m USING (signal) GROUP BY s.signal"""),
        "coverage_by_rule": with_(SIGNALS, "SELECT signal, rule, count(*) AS messages FROM (SELECT signal, unnest(rules) AS rule FROM matched) GROUP BY ALL"),
        "uncovered_samples": with_(SIGNALS, f"""
SELECT signal, n, {mid('sid', 'idx')} AS message, array_to_string(rules, ' ') AS blind, trim({squash('text')}) AS text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY signal ORDER BY sid, idx) AS INTEGER) AS n FROM matched WHERE NOT real) WHERE n <= 3"""),
    }


def verdicts() -> dict[str, str]:
    flags = " OR ".join(V.FORMS)
    combo = "concat_ws('+', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in V.FORMS) + ")"
    return {
        "markers": query("SELECT key, sid, ord, kind, confidence FROM markers"),
        "verdict_agreement": with_(JUDGED, """
SELECT verdict, regex, count(*) AS n, (SELECT 100.0::DOUBLE * count(*) FILTER (verdict = regex) / count(*) FROM judged) AS agreement_pct FROM judged GROUP BY verdict, regex"""),
        "verdict_disagreements": with_(JUDGED, """
SELECT CASE WHEN verdict THEN 'regex missed' ELSE 'regex false positive' END AS "case", key, kind, confidence, substr(text, 1, 74) AS text
FROM judged WHERE verdict <> regex ORDER BY ord, key LIMIT 12"""),
        "desync_kind_counts": query("SELECT desync, kind, count(*) AS n FROM desync_last GROUP BY ALL"),
        "directive_strength": query("""
SELECT 'strength' AS field, strength AS value, count(*) AS n FROM directive_last GROUP BY ALL
UNION ALL SELECT 'confidence', confidence, count(*) FROM directive_last GROUP BY ALL"""),
        "directive_forms": query(" UNION ALL ".join(f"SELECT '{f}' AS form, count(*) FILTER ({f}) AS n FROM directive_last" for f in V.FORMS)),
        "directive_combos": query(f"""
SELECT CASE WHEN c = '' THEN '(none flagged)' ELSE c END AS forms, count(*) AS n FROM (SELECT {combo} AS c FROM directive_last WHERE strength = 'weakened') GROUP BY ALL"""),
        "verdict_contract": with_(PREVIOUS, f"""
SELECT key, ord, broken FROM (SELECT d.key, d.ord, concat_ws(',',
  CASE WHEN kind NOT IN ({', '.join(lit(k) for k in V.DESYNC_KINDS)}) OR confidence NOT IN ('low', 'medium', 'high') THEN 'bad-enum' END,
  CASE WHEN NOT desync AND kind <> 'none' THEN 'kind-without-desync' END,
  CASE WHEN confidence = 'high' AND contradicts = '' THEN 'high-without-contradicts' END,
  CASE WHEN quote <> '' AND NOT contains(d.text, quote) THEN 'quote-not-verbatim' END,
  CASE WHEN contradicts <> '' AND NOT contains(p.previous, contradicts) THEN 'contradicts-not-verbatim' END) AS broken
  FROM desync d JOIN (SELECT key, arg_min(previous, idx) AS previous FROM previous GROUP BY key) p USING (key)) WHERE broken <> ''"""),
        "directive_contract": query(f"SELECT key, ord, 'flag-without-weakened' AS broken FROM directive WHERE ({flags}) AND strength <> 'weakened'"),
    }


def trace() -> dict[str, str]:
    return {
        "active_rules": with_(ACTIVE, "SELECT sid, idx, rule FROM active"),
        "lookback_trace": with_(BACK, """
SELECT key, sid, at_idx, back, idx, coalesce((SELECT string_agg(rule, ' ' ORDER BY rule) FROM active a WHERE a.sid = b.sid AND a.idx = b.idx), '') AS fired,
  coalesce((SELECT string_agg(fact || ' x' || n, ', ' ORDER BY fact) FROM state_facts s WHERE s.sid = b.sid AND s.idx = b.idx), '') AS facts FROM back b"""),
        "rules_before_markers": with_(BACK, "SELECT rule, count(*) AS n, rule IN ('R03', 'R05') AS content_blind FROM back JOIN active USING (sid, idx) GROUP BY ALL"),
        "facts_before_markers": with_(BACK, "SELECT fact, count(*) AS n FROM back JOIN state_facts USING (sid, idx) GROUP BY ALL"),
        "silent_markers": with_(BACK, """
SELECT key, sid, idx, kind FROM located l WHERE idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM back b WHERE b.key = l.key AND (
  EXISTS (SELECT 1 FROM active a WHERE a.sid = b.sid AND a.idx = b.idx AND a.rule NOT IN ('R03', 'R05'))
  OR EXISTS (SELECT 1 FROM state_facts s WHERE s.sid = b.sid AND s.idx = b.idx)))"""),
        "marker_location": query("""
SELECT count(*) AS markers, count(*) FILTER (here) AS located, count(*) FILTER (NOT here) AS unmatched
FROM (SELECT key IN (SELECT key FROM msgs) AS here FROM markers)"""),
        "fact_lift": with_(BACK, """
SELECT fact, before_share, base_share, before_share / base_share AS lift FROM (
  SELECT f.fact, (SELECT count(*) FROM back JOIN state_facts s USING (sid, idx) WHERE s.fact = f.fact) / (SELECT count(*) FROM back) AS before_share,
    count(*) / (SELECT count(*) FROM msgs) AS base_share FROM state_facts f GROUP BY f.fact)"""),
        "lookahead_rates": with_(AHEAD, "SELECT k, strength, total, hits, rate FROM rates"),
        "relative_risk": with_(AHEAD, """
SELECT d.k, d.rate AS direct_rate, w.rate AS weakened_rate, w.rate / nullif(d.rate, 0) AS relative_risk
FROM (SELECT * FROM rates WHERE strength = 'direct') d JOIN (SELECT * FROM rates WHERE strength = 'weakened') w USING (k)"""),
        "form_rates": with_(AHEAD, """
SELECT form, count(*) AS total, count(*) FILTER (followed) AS hits, count(*) FILTER (followed) / count(*) AS rate,
  count(*) FILTER (followed) / count(*) / (SELECT rate FROM rates WHERE k = 3 AND strength = 'direct') AS vs_direct FROM forms GROUP BY form"""),
        "form_examples": with_(AHEAD, f"""
SELECT form, n, {mid('sid', 'idx')} AS message, substr(text, 1, 84) AS text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY form ORDER BY sid, idx) AS INTEGER) AS n FROM forms WHERE followed) WHERE n <= 4"""),
    }


def reduction() -> dict[str, str]:
    return {
        "epoch_plan": capture_query("SELECT sid, count, event, bytes, epoch, in_flight, is_base FROM plan"),
        "epoch_bases": capture_query("SELECT sid, epoch, base_count, base_bytes FROM bases"),
        "prefix_digests": capture_query("""
SELECT sid, epoch, bytes, sha256(unhex(h)) AS prefix_sha, len(list_filter(regexp_extract_all(h, '..'), lambda x: x = '0A')) AS prefix_lines
FROM (SELECT DISTINCT p.sid, p.epoch, p.bytes, substr(hex(b.base), 1, 2 * p.bytes) AS h FROM plan p
  JOIN bases b ON b.sid = p.sid AND b.epoch = p.epoch WHERE p.bytes > 0 AND p.bytes <= b.base_bytes)"""),
        "reduction_index": INDEX_ROWS,
        "payload_facts": capture_query(f"""
SELECT sid, count, event, CASE WHEN n % 2 = 0 THEN 'manual' END AS compact_trigger, n % 3 = 0 AS has_custom_instructions,
  CASE WHEN event = 'PostCompact' THEN CAST(length('summary of ' || count) AS INTEGER) END AS compact_summary_chars
FROM (SELECT *, {CONV} + count AS n FROM index_) WHERE event IN ('PreCompact', 'PostCompact')"""),
        "reduced_store": capture_query("""
SELECT i.sid, i.epoch, i.count, 'base' AS kind, CAST(i.bytes AS INTEGER) AS bytes, i.sha256 FROM index_ i WHERE i.source = 'epoch' AND i.count = i.base_count
UNION ALL SELECT sid, epoch, count, source, CAST(bytes AS INTEGER), sha256 FROM index_ WHERE source IN ('inflight', 'full')"""),
        "reconstruct_capture": capture_query("SELECT sid, count, source, sha256 FROM index_ WHERE source <> 'missing'"),
        "reduced_store_lines": capture_query("""
SELECT DISTINCT sha256(line) AS address, CAST(strlen(line) AS INTEGER) AS bytes FROM (
  SELECT part || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS line FROM (
    SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS i, parts FROM (
      SELECT string_split(content, chr(10)) AS parts FROM index_ WHERE source IN ('inflight', 'full') OR (source = 'epoch' AND count = base_count))))
WHERE line <> ''"""),
        "reconstruct_from_lines": capture_query("SELECT sid, count, source, sha256 FROM index_ WHERE source <> 'missing'"),
        "reduction_index_incremental": INDEX_ROWS,
        "compaction_annotations": conversations_json(),
        "verify_roundtrip": captures_with(TAMPERED, "SELECT source, coalesce(failure, 'ok') AS outcome, count(*) AS n FROM checks GROUP BY ALL"),
        "verify_against_source": captures_with(TAMPERED, "SELECT sid, count, sha256 = true_sha AS matches FROM tampered WHERE exists_ AND source <> 'missing'"),
        "staleness": captures_with(STALE, "SELECT sid, unindexed, events_copy, stale, failed FROM stale"),
        "prune_eligible": captures_with(TAMPERED + "," + STALE, """
SELECT sid FROM stale WHERE NOT stale AND NOT failed AND sid NOT IN (SELECT sid FROM checks WHERE failure IS NOT NULL)"""),
        "reduction_stats": capture_query("""
SELECT sid, captures, epoch, inflight, "full", empty, missing, orig_bytes, base_bytes, full_bytes, orig_bytes / nullif(base_bytes + full_bytes, 0) AS ratio FROM (
  SELECT sid, count(*) AS captures, count(*) FILTER (source = 'epoch') AS epoch, count(*) FILTER (source = 'inflight') AS inflight,
    count(*) FILTER (source = 'full') AS "full", count(*) FILTER (source = 'empty') AS empty, count(*) FILTER (source = 'missing') AS missing,
    CAST(sum(bytes) AS BIGINT) AS orig_bytes, CAST(coalesce(sum(bytes) FILTER (source = 'epoch' AND count = base_count), 0) AS BIGINT) AS base_bytes,
    CAST(coalesce(sum(bytes) FILTER (source IN ('inflight', 'full')), 0) AS BIGINT) AS full_bytes FROM index_ GROUP BY ROLLUP (sid))"""),
        "corpus_stats": captures_with(FILES, """
SELECT count(DISTINCT sid) FILTER (path LIKE '%.events.jsonl') AS sessions, count(*) FILTER (path LIKE '%.transcript.jsonl') AS snapshots,
  CAST(sum(length) AS BIGINT) AS bytes FROM files"""),
        "retention_by_age": captures_with(FILES, f"SELECT path FROM files WHERE modified_us < {EPOCH_US + 1_800_000_000}"),
        "retention_keep_n": captures_with(FILES, f"""
SELECT path FROM files WHERE modified_us < {EPOCH_US + 1_800_000_000}
  OR sid NOT IN (SELECT sid FROM files GROUP BY sid ORDER BY max(modified_us) DESC, sid LIMIT 10)"""),
        "capture_deltas": capture_query("""
SELECT sid, scale, a.count AS from_count, b.count AS to_count, b.bytes - a.bytes AS bytes_delta, b.lines - a.lines AS lines_delta,
  (b.captured_us - a.captured_us) / 1e6 AS seconds FROM (
  SELECT b.sid, 'turn' AS scale, b.count AS to_, (SELECT max(a.count) FROM listing a WHERE a.sid = b.sid AND a.event = 'Stop' AND a.count < b.count) AS from_
    FROM listing b WHERE b.event = 'Stop'
  UNION ALL SELECT b.sid, 'compaction', b.count, (SELECT CASE WHEN arg_max(a.event, a.count) = 'PreCompact' THEN max(a.count) END FROM listing a
    WHERE a.sid = b.sid AND a.event IN ('PreCompact', 'PostCompact') AND a.count < b.count) FROM listing b WHERE b.event = 'PostCompact'
  UNION ALL SELECT b.sid, 'session', b.count, (SELECT max(a.count) FROM listing a WHERE a.sid = b.sid AND a.event = 'SessionStart' AND a.count < b.count)
    FROM listing b WHERE b.count = (SELECT max(count) FROM listing x WHERE x.sid = b.sid)) d
JOIN listing a ON a.sid = d.sid AND a.count = d.from_ JOIN listing b ON b.sid = d.sid AND b.count = d.to_""".replace("SELECT sid,", "SELECT d.sid,", 1)),
    }


def oplog() -> dict[str, str]:
    return {
        "fires_summary": with_(FIRE_LOG, """
SELECT rule, count(*) AS fires, count(*) FILTER (surfaced) AS surfaced, count(*) FILTER (deduped) AS deduped FROM fire_log GROUP BY ROLLUP (rule)"""),
        "suppression_counts": with_(FIRE_LOG, "SELECT suppressed, count(*) AS n FROM fire_log WHERE suppressed IS NOT NULL GROUP BY ALL"),
        "latency_bands": with_(FIRE_LOG, bands("SELECT 'elapsed' AS band, elapsed_ms AS value FROM fire_log")),
        "normalise_summary": with_(NORMALISE, "SELECT status, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM norm) AS pct FROM norm GROUP BY status"),
        "normalise_bands": with_(NORMALISE, bands("""
SELECT 'total' AS band, nullif(elapsed_ms, 0) AS value FROM norm UNION ALL SELECT 'request', request_ms FROM norm UNION ALL SELECT 'setup', setup_ms FROM norm""")),
        "normalise_pairs": with_(NORMALISE, f"""
SELECT ts, sid, status, elapsed_ms, substr(trim({squash('prompt')}), 1, 300) AS prompt, substr(trim({squash('restatement')}), 1, 300) AS restatement
FROM norm WHERE status = 'restated' ORDER BY ts DESC, seq DESC LIMIT 20"""),
        "verdict_tally": query("SELECT verdict, count(*) AS n FROM label_rows GROUP BY ALL"),
        "routing_buckets": with_(REFRESHED, f"""
SELECT bucket, string_agg(rule, ' ' ORDER BY rule) AS rules, coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS reasons FROM (
  SELECT rule, CASE WHEN act = 'log' THEN CASE WHEN suspended THEN 'suspended' ELSE 'floored' END ELSE act END AS bucket,
    CASE WHEN suspended THEN rule || ': ' || split_part(suspended_reason, '.', 1) END AS reason
  FROM (SELECT *, {action_case()} AS act FROM refreshed)) GROUP BY bucket"""),
        "catalogue_drift": with_(REFRESHED, f"""
SELECT *, 'left' AS side FROM (SELECT {CATALOGUE_COLUMNS} FROM catalogue EXCEPT ALL SELECT {CATALOGUE_COLUMNS} FROM refreshed)
UNION ALL SELECT *, 'right' FROM (SELECT {CATALOGUE_COLUMNS} FROM refreshed EXCEPT ALL SELECT {CATALOGUE_COLUMNS} FROM catalogue)"""),
    }


TEN = 600_000_000  # microseconds of a window
TIMED = """
timed AS (SELECT f.sid, m.us, f.rule AS what FROM fires f JOIN msgs m USING (sid, idx) WHERE m.us IS NOT NULL
  UNION ALL SELECT sid, us, 'error' FROM facts WHERE kind = 'api_error' AND us IS NOT NULL)
"""


def streaming() -> dict[str, str]:
    return {
        "stream_sequence": query("SELECT sid, seq, row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS n FROM facts"),
        "stream_dedupe": query("SELECT kind, count(*) AS n FROM facts GROUP BY ALL"),
        "stream_tail": line_counts(COPIES, ATTACHED),
        "stream_windows": with_(TIMED, f"""
SELECT 'tumbling' AS shape, NULL::VARCHAR AS sid, what, us // {TEN} * {TEN} AS start_us, us // {TEN} * {TEN} + {TEN} AS end_us, count(*) AS n
FROM timed GROUP BY ALL
UNION ALL SELECT 'sliding', NULL, what, start_us, start_us + {TEN}, count(*) FROM (
  SELECT what, (us // {TEN // 2} - back) * {TEN // 2} AS start_us FROM timed, range(2) AS r(back)) GROUP BY ALL
UNION ALL SELECT 'session', sid, what, min(us), max(us) + {TEN // 2}, count(*) FROM (
  SELECT *, sum(begins) OVER (PARTITION BY sid, what ORDER BY us, place) AS nth FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY sid, what ORDER BY us, place) < {TEN // 2} THEN 0 ELSE 1 END AS begins FROM (
      SELECT *, row_number() OVER () AS place FROM timed))) GROUP BY sid, what, nth"""),
        "stream_rules": query("SELECT sid, idx, rule, key FROM fires"),
        "stream_routing": with_(ROUTED, "SELECT sid, idx, rule, key, surfaced, deduped, suppressed FROM routed"),
        "stream_verdicts": with_(PENDING, "SELECT sid, asked_idx, rule, key, verdict FROM settled"),
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in (sources, shape, state, rules, routing, labels, coverage, verdicts, trace, reduction, oplog, streaming):
        out.update(group())
    return out
