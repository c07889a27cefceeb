"""SQL views over the driver's tables, written for DuckDB and independent of the Spark plans.

Joins here are deliberately direct (every message against every earlier fact of its session): the
point is to state what must come out, not to be fast.
"""

from __future__ import annotations

import json

from turnscope.functions import vocab as V
from turnscope.sources import catalogue as C
from turnscope.sources.views import COMPRESSION, EPOCH_US, TEMPLATES


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def tokens(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), {lit(V.TOKEN)}), "
        f"lambda t: NOT list_contains({array(V.STOP_WORDS)}, t))))"
    )


def refs(x: str, *patterns: str) -> str:
    parts = [f"regexp_extract_all({x}, {lit(p)})" for p in patterns]
    return "list_sort(list_distinct(" + (f"list_concat({', '.join(parts)})" if len(parts) > 1 else parts[0]) + "))"


def sha12(x: str) -> str:
    return f"substr(sha1({x}), 1, 12)"


def key(sid: str, text: str) -> str:
    return f"substr(sha1({sid} || '|' || {text}), 1, 16)"


def squash(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def mid(sid: str, idx: str) -> str:
    return f"printf('%s#%04d', substr({sid}, 1, 8), {idx})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def template(seq: str, k: str) -> str:
    return f"replace({array(TEMPLATES)}[{seq} % 16 + 1], '#', coalesce({k}, ''))"


def catalogue_values() -> str:
    rows = []
    for r in json.loads(C.PACKAGED.read_text())["rules"]:
        b = r["metrics"]["backtest"]
        fix = r.get("fix")
        fix = fix.get("fallback") if isinstance(fix, dict) else fix
        p = r["metrics"]["precision"]
        rows.append("(" + ", ".join([
            lit(r["id"]), lit(r["action"]), str(bool(r.get("suspended"))).lower(), lit(r.get("suspended_reason")),
            "NULL" if p is None else f"{p}::DOUBLE", lit(b["basis"]), f"{b['refuted']}::BIGINT",
            f"{b['hand_labelled']}::BIGINT", lit(fix),
        ]) + ")")
    return ", ".join(rows)


def action_case(p: str = "precision") -> str:
    return f"""CASE WHEN suspended THEN 'log' WHEN action IN ('augment', 'annotate', 'resend') THEN 'augment'
      WHEN {p} >= {V.PRECISION_CEILING} AND (basis = 'auto' OR hand_labelled > 0) THEN 'apply'
      WHEN {p} < {V.PRECISION_FLOOR} AND (basis = 'auto' OR hand_labelled > 0) AND refuted > 0 THEN 'log'
      ELSE 'ask' END"""


BASIS_VALUES = ", ".join(f"({lit(r)}, {lit(b)})" for r, b in V.BASIS.items())
SIGNAL_VALUES = ", ".join(f"({lit(n)})" for n, _ in V.SIGNALS)
SIGNAL_LIST = "[" + ", ".join(
    f"CASE WHEN {matches('text', p)} THEN {lit(n)} END" for n, p in V.SIGNALS) + "]"
ANY_SIGNAL = " OR ".join(matches("text", p) for _, p in V.SIGNALS)
HUMAN_OP = f"kind = 'queue' AND length(text) > 0 AND NOT {matches('text', V.SYSTEM_PREFIX)}"
DEDUPED = ", ".join(lit(r) for r in C.deduped_rules())
BEFORE = "(f.ts, f.seq) < (m.ts, m.seq)"

# name -> body, in dependency order
VIEWS = {
    "ev": f"""
  SELECT *, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS ts FROM (
    SELECT CAST(user_id AS VARCHAR) AS sid, event_id AS seq, event_type, value AS elapsed_ms,
      {EPOCH_US} + (epoch_us(ts) - {EPOCH_US}) // {COMPRESSION} AS us, json_extract_string(props, '$.k') AS k
    FROM events)""",
    "f0": f"""
  SELECT *, CASE WHEN kind = 'message' THEN {template('seq', 'k')}
      WHEN kind = 'queue' THEN CASE WHEN seq % 7 = 0 THEN '' WHEN seq % 7 = 1
        THEN '<system-reminder>note</system-reminder>' ELSE {template('seq', 'k')} END
      WHEN kind = 'launch' THEN 'working on item ' || k END AS text,
    CASE WHEN kind = 'queue' THEN ['enqueue', 'remove', 'dequeue'][seq % 3 + 1]
      WHEN kind = 'denial' THEN CASE WHEN seq % 2 = 0 THEN 'clarify' ELSE 'user-rejected' END END AS op,
    last_value(CASE WHEN kind = 'launch' THEN seq END IGNORE NULLS) OVER w AS last_launch,
    last_value(CASE WHEN kind = 'question' THEN seq END IGNORE NULLS) OVER w AS last_question
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'queue'
      WHEN 'error' THEN 'api_error' WHEN 'signup' THEN CASE WHEN seq % 2 = 0 THEN 'launch' ELSE 'question' END
      ELSE CASE WHEN seq % 3 = 0 THEN 'denial' WHEN seq % 3 = 1 THEN 'notified'
        WHEN seq % 5 = 0 THEN 'stop_failed' ELSE 'ended' END END AS kind FROM ev)
  WINDOW w AS (PARTITION BY sid ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "facts": """
  SELECT sid, ts, seq, us, kind, op, text, elapsed_ms, CASE kind WHEN 'launch' THEN 'L' || seq
    WHEN 'question' THEN 'Q' || seq WHEN 'notified' THEN 'L' || last_launch WHEN 'ended' THEN 'L' || last_launch
    WHEN 'stop_failed' THEN 'L' || last_launch WHEN 'denial' THEN 'Q' || last_question END AS ref
  FROM f0""",
    "msgs": f"""
  SELECT sid, ts, seq, us, text, elapsed_ms, {key('sid', 'text')} AS key,
    row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS idx FROM facts WHERE kind = 'message'""",
    "presend": f"""
  SELECT m.sid, m.idx, m.idx - 1 AS prior_messages,
    count(*) FILTER (f.kind = 'queue') AS queue_ops,
    count(*) FILTER (f.kind = 'launch') AS launches, count(*) FILTER (f.kind = 'api_error') AS api_errors,
    count(*) FILTER (f.kind = 'denial') AS denials,
    count(*) FILTER (f.kind = 'queue' AND f.op = 'remove' AND length(f.text) > 0
      AND NOT {matches('f.text', V.SYSTEM_PREFIX)}) AS removes
  FROM msgs m LEFT JOIN facts f ON f.sid = m.sid AND {BEFORE} GROUP BY ALL""",
    "stale": f"""
  SELECT m.sid, m.idx, f.ref AS task FROM msgs m JOIN facts f ON f.sid = m.sid AND f.kind = 'launch'
    AND {BEFORE} AND f.us < m.us
  WHERE NOT EXISTS (SELECT 1 FROM facts t WHERE t.sid = m.sid AND t.kind IN ('notified', 'ended')
    AND t.ref = f.ref AND (t.ts, t.seq) < (m.ts, m.seq) AND t.us <= m.us)""",
    "unreported": f"""
  SELECT m.sid, m.idx, f.ref AS task FROM msgs m JOIN facts f ON f.sid = m.sid AND f.kind = 'launch' AND {BEFORE}
  WHERE NOT EXISTS (SELECT 1 FROM facts t WHERE t.sid = m.sid AND t.kind = 'notified'
    AND t.ref = f.ref AND (t.ts, t.seq) < (m.ts, m.seq))""",
    "asof_questions": f"""
  SELECT m.sid, m.idx, f.ref AS question, coalesce((SELECT arg_max(d.op, d.ts || printf('%015d', d.seq)) FROM facts d
      WHERE d.sid = m.sid AND d.kind = 'denial' AND d.ref = f.ref AND (d.ts, d.seq) < (m.ts, m.seq)
        AND (d.ts, d.seq) > (f.ts, f.seq)), 'answered') AS outcome
  FROM msgs m JOIN facts f ON f.sid = m.sid AND f.kind = 'question' AND {BEFORE}""",
    "state_facts": """
  SELECT * FROM (
    SELECT sid, idx, 'open-question' AS fact, count(*) AS n FROM asof_questions WHERE outcome <> 'answered' GROUP BY ALL
    UNION ALL SELECT sid, idx, 'unreported-task', count(*) FROM unreported GROUP BY ALL
    UNION ALL SELECT sid, idx, 'queue-remove', removes FROM presend
    UNION ALL SELECT sid, idx, 'api-error', api_errors FROM presend
    UNION ALL SELECT sid, idx, 'denial', denials FROM presend) WHERE n > 0""",
    "known_refs": f"""
  SELECT DISTINCT unnest({refs('text', V.PATH, V.REPO)}) AS ref FROM msgs WHERE (seq // 16) % 2 = 0""",
    "probes": """
  SELECT CASE WHEN seq % 4 = 0 THEN 'https://example.org/status'
      ELSE 'http://localhost:30' || (seq % 100) || '/health' END AS url, ts, us, seq,
    CASE seq % 3 WHEN 0 THEN true WHEN 1 THEN false END AS serves FROM facts WHERE kind = 'api_error'""",
    "url_states": f"""
  SELECT u.sid, u.idx, u.url, (SELECT arg_max(CASE WHEN p.serves IS NULL THEN 'unknown' WHEN p.serves THEN 'up' ELSE 'down' END,
      p.ts || printf('%015d', p.seq)) FROM probes p WHERE p.url = u.url AND p.ts <= u.ts) AS status
  FROM (SELECT sid, idx, ts, unnest({refs('text', V.URL)}) AS url FROM msgs) u""",
    "lost": f"""
  SELECT m.sid, m.idx, q.us AS op_us FROM msgs m JOIN facts q ON q.sid = m.sid AND q.kind = 'queue' AND q.op = 'dequeue'
      AND (q.ts, q.seq) < (m.ts, m.seq)
    AND EXISTS (SELECT 1 FROM facts e WHERE e.sid = m.sid AND e.kind = 'api_error' AND (e.ts, e.seq) < (m.ts, m.seq)
      AND abs(e.us - q.us) <= 90000000)""",
    "r02": """
  SELECT sid, idx, 'R02' AS rule, 'tasks:' || n || ':' || w AS key,
    n || ' task(s) running without any sign of an end' AS why, n || ':' || w AS detail, CAST([] AS VARCHAR[]) AS subject
  FROM (SELECT sid, idx, count(*) AS n, sum(CAST('0x' || substr(sha1(task), 1, 12) AS BIGINT)) AS w FROM stale GROUP BY sid, idx)""",
    "r03": """
  SELECT sid, idx, 'R03' AS rule, 'session:' || sid AS key, 'say at the start which kinds of operation are off limits' AS why,
    'depends on the permission mode' AS detail, CAST([] AS VARCHAR[]) AS subject FROM msgs WHERE idx = 1""",
    "r04": """
  SELECT sid, min(idx) AS idx, 'R04' AS rule, 'question:' || question AS key,
    'a question was ' || arg_min(outcome, idx) || ' and is still open' AS why,
    question AS detail, CAST([] AS VARCHAR[]) AS subject
  FROM asof_questions WHERE outcome <> 'answered' GROUP BY sid, question""",
    "r05": f"""
  SELECT sid, idx, 'R05' AS rule, 'endpoints:' || {sha12("array_to_string(found, '|')")} AS key,
    'the text cites endpoint paths, which may be out of date' AS why, substr(array_to_string(found, ', '), 1, 200) AS detail,
    {tokens("array_to_string(found, ' ')")} AS subject
  FROM (SELECT *, {refs('text', V.ENDPOINT)} AS found FROM msgs) WHERE len(found) > 0""",
    "r06": f"""
  SELECT sid, idx, 'R06' AS rule, 'refs:' || {sha12("array_to_string(missing, '|')")} AS key,
    'not found: ' || array_to_string(missing, ', ') AS why,
    substr(array_to_string(missing, ', '), 1, 200) AS detail, {tokens("array_to_string(missing, ' ')")} AS subject
  FROM (SELECT sid, idx, list(ref ORDER BY ref) AS missing
    FROM (SELECT sid, idx, unnest({refs('text', V.PATH, V.REPO)}) AS ref FROM msgs)
    WHERE ref NOT IN (SELECT ref FROM known_refs) GROUP BY sid, idx)""",
    "r08": f"""
  SELECT sid, idx, 'R08' AS rule, 'urls:' || {sha12("array_to_string(dead, '|')")} AS key,
    'not answering: ' || array_to_string(dead, ', ') AS why,
    substr(array_to_string(dead, ', '), 1, 200) AS detail, {tokens("array_to_string(dead, ' ')")} AS subject
  FROM (SELECT sid, idx, list(url ORDER BY url) AS dead FROM url_states WHERE status = 'down' GROUP BY sid, idx)""",
    "r10": f"""
  SELECT sid, idx, 'R10' AS rule, 'criterion:' || {sha12('text')} AS key,
    'asks for open-ended work without saying when it is done' AS why, substr({squash('text')}, 1, 200) AS detail,
    {tokens('text')} AS subject FROM msgs WHERE {matches('text', V.NO_CRITERION)}""",
    "r11": f"""
  SELECT sid, idx, 'R11' AS rule, 'scope:' || {sha12('text')} AS key,
    'claims an absolute scope: for good, or only for now?' AS why, substr({squash('text')}, 1, 200) AS detail,
    {tokens('text')} AS subject FROM msgs WHERE {matches('text', V.ABSOLUTE)}""",
    "r12": """
  SELECT sid, min(idx) AS idx, 'R12' AS rule, 'lost:' || stamp AS key,
    'a queued message left around an API error and may be lost' AS why,
    'dequeue at ' || stamp AS detail, CAST([] AS VARCHAR[]) AS subject
  FROM (SELECT *, replace(strftime(make_timestamp(op_us), '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00' AS stamp FROM lost)
  GROUP BY sid, stamp""",
    "r13": f"""
  SELECT sid, idx, 'R13' AS rule, 'prov:' || {sha12('text')} AS key, 'note where the message came from' AS why,
    'prompt_chars=' || length(text) AS detail, CAST([] AS VARCHAR[]) AS subject FROM msgs""",
    # every pair of texts that a rule or label compares
    "near": """
  SELECT sid, idx, prev AS a, text AS b FROM (SELECT *, lag(text) OVER w AS prev, us - lag(us) OVER w AS gap FROM msgs
    WINDOW w AS (PARTITION BY sid ORDER BY idx)) WHERE length(text) >= 25 AND length(prev) >= 25 AND gap <= 120000000
    AND 2.0 * least(length(text), length(prev)) / (length(text) + length(prev)) >= 0.85""",
    "drafts": f"""
  SELECT f.sid, f.seq, f.text AS a, (SELECT count(*) FROM msgs m WHERE m.sid = f.sid AND (m.ts, m.seq) < (f.ts, f.seq)) + 1 AS upto
  FROM facts f WHERE {HUMAN_OP.replace('kind', 'f.kind').replace('text', 'f.text')} AND f.op = 'remove' AND length(f.text) >= 20""",
    "said": "SELECT sid, text AS b, min(idx) AS first_idx FROM msgs GROUP BY ALL",
    "family": f"SELECT DISTINCT sid, text FROM msgs WHERE {matches('text', V.NO_CRITERION)}",
    "pairs": """
  SELECT DISTINCT a, b FROM (SELECT a, b, 0.55 AS least_ FROM drafts JOIN said USING (sid) UNION ALL SELECT a, b, 0.85 FROM near
    UNION ALL SELECT x.text, y.text, 0.7 FROM family x JOIN family y USING (sid))
  WHERE 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= least_""",
    # the longest common block, the first in a, then in b; then the same on what lies left and right of it
    "blocks": """
  SELECT a, b, a AS s, b AS t, 0 AS m FROM pairs UNION ALL
  SELECT a, b, unnest([substr(s, 1, i - 1), substr(s, i + n)]), unnest([substr(t, 1, j - 1), substr(t, j + n)]), unnest([n, 0])
  FROM (SELECT *, instr(t, substr(s, i, n)) AS j FROM (SELECT *, list_position(ns, n) AS i FROM (SELECT *, list_max(ns) AS n FROM (
    SELECT a, b, s, t, list_transform(range(1, length(s) + 1), lambda i: coalesce(list_max(list_filter(
      range(1, length(s) - i + 2), lambda n: contains(t, substr(s, i, n)))), 0)) AS ns
    FROM blocks WHERE s <> '' AND t <> '')) WHERE n > 0))""",
    "ratios": "SELECT a, b, 2.0 * sum(m) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b",
    "resolved": """
  SELECT d.sid, d.seq, min(s.first_idx) AS hit FROM drafts d JOIN said s USING (sid) JOIN ratios r ON r.a = d.a AND r.b = s.b
  WHERE r.ratio >= 0.55 GROUP BY ALL""",
    "open_drafts": """
  SELECT d.*, r.hit FROM drafts d LEFT JOIN resolved r USING (sid, seq) JOIN msgs m ON m.sid = d.sid AND m.idx = d.upto
  WHERE r.hit IS NULL OR r.hit > d.upto""",
    "r01": f"""
  SELECT DISTINCT sid, upto AS idx, 'R01' AS rule, 'retraction:' || {sha12('a')} AS key,
    'a queued draft was taken back and nothing like it was sent since' AS why, substr({squash('a')}, 1, 200) AS detail,
    {tokens('a')} AS subject FROM open_drafts""",
    "r07": f"""
  SELECT sid, idx, 'R07' AS rule, 'dup:' || {sha12('a')} || ':' || {sha12('b')} AS key,
    CASE WHEN flips THEN 'repeats the previous message with a negation flipped; both stay in view'
      ELSE 'nearly the same as the previous message; both stay in view' END AS why,
    'similarity ' || printf('%.2f', ratio) || CASE WHEN flips THEN ', negation differs' ELSE '' END AS detail, {tokens('b')} AS subject
  FROM (SELECT *, len(regexp_extract_all(a, {lit(V.NEGATION)})) <> len(regexp_extract_all(b, {lit(V.NEGATION)})) AS flips
    FROM near JOIN ratios USING (a, b) WHERE ratio >= 0.85)""",
    "fires": " UNION ALL ".join(
        f"SELECT sid, idx, rule, key, why, detail, subject FROM {r}"
        for r in ("r01", "r02", "r03", "r04", "r05", "r06", "r07", "r08", "r10", "r11", "r12", "r13")),
    "firsts": f"""
  SELECT sid, rule, key, min(idx) AS idx FROM fires WHERE rule IN ({DEDUPED}) GROUP BY ALL""",
    "fires1": f"""
  SELECT * FROM fires WHERE rule NOT IN ({DEDUPED})
  UNION ALL SELECT fires.* FROM fires JOIN firsts USING (sid, rule, key, idx)""",
    "catalogue": f"""
  SELECT * FROM (VALUES {catalogue_values()})
    AS c(rule, action, suspended, suspended_reason, precision, basis, refuted, hand_labelled, template)""",
    "basis": f"SELECT * FROM (VALUES {BASIS_VALUES}) AS b(rule, basis)",
    "desync": f"""
  SELECT {key('sid', 'text')} AS key, sid, seq * 2 + w AS ord, (seq + w) % 5 = 0 AS desync,
    CASE WHEN (seq + w) % 5 = 0 OR seq % 31 = 0 THEN {array(V.DESYNC_KINDS[:-1])}[seq % 6 + 1] ELSE 'none' END AS kind,
    {array(V.CONFIDENCE)}[seq % 3 + 1] AS confidence,
    CASE seq % 4 WHEN 0 THEN substr(text, 1, 12) WHEN 1 THEN 'not in it' ELSE '' END AS quote,
    CASE WHEN (seq + w) % 5 = 0 AND seq % 6 = 2 THEN 'item ' || (seq % 10) ELSE '' END AS contradicts,
    substr(trim({squash('text')}), 1, 300) AS text
  FROM msgs, (VALUES (0), (1)) AS writes(w) WHERE w = 0 OR seq % 9 = 0""",
    "desync_last": "SELECT DISTINCT ON (key) * FROM desync ORDER BY key, ord DESC",
    "markers": "SELECT * FROM desync_last WHERE desync",
    "directive": f"""
  SELECT key, sid, ord, strength <> 'none' AS is_directive, strength,
    (strength = 'weakened' OR ord % 29 = 0) AND (ord // 4) % 2 = 1 AS hedged,
    (strength = 'weakened' OR ord % 29 = 0) AND (ord // 8) % 2 = 1 AS understated,
    (strength = 'weakened' OR ord % 29 = 0) AND (ord // 16) % 2 = 1 AS interrogative,
    (strength = 'weakened' OR ord % 29 = 0) AND (ord // 32) % 2 = 1 AS optative,
    {array(V.CONFIDENCE)}[ord % 3 + 1] AS confidence, text
  FROM (SELECT key, sid, seq AS ord, substr(trim({squash('text')}), 1, 300) AS text,
    CASE seq % 4 WHEN 0 THEN 'direct' WHEN 3 THEN 'none' ELSE 'weakened' END AS strength FROM msgs)""",
    "directive_last": "SELECT DISTINCT ON (key) * FROM directive ORDER BY key, ord DESC",
    "label_rows": f"""
  SELECT seq AS ord, sid, ['R10', 'R11', 'R13'][seq % 3 + 1] AS rule,
    ['criterion:', 'scope:', 'prov:'][seq % 3 + 1] || {sha12('text')} AS fire_key,
    CASE WHEN seq % 8 = 0 THEN 'unlabelled' WHEN seq % 5 < 3 THEN 'applies' ELSE 'does-not-apply' END AS verdict,
    seq % 13 = 0 AS synthetic, CASE WHEN seq % 2 = 0 THEN 'manual-review' ELSE 'verdict-reply' END AS source
  FROM msgs WHERE seq % 4 < 2""",
    "hand": """
  SELECT rule, fire_key AS key, verdict = 'applies' AS hand FROM (
    SELECT DISTINCT ON (rule, fire_key) * FROM label_rows
    WHERE synthetic OR verdict IN ('applies', 'does-not-apply') ORDER BY rule, fire_key, ord DESC)
  WHERE NOT synthetic""",
    "hand_latest": """
  SELECT DISTINCT ON (rule, fire_key) rule, fire_key AS key, verdict FROM label_rows
  WHERE verdict IN ('applies', 'does-not-apply') ORDER BY rule, fire_key, ord DESC""",
    "toks": f"SELECT *, {tokens('text')} AS toks FROM msgs",
    "corrections": """
  SELECT DISTINCT ON (f.sid, f.idx, f.rule, f.key) f.sid, f.idx, f.rule, f.key, m.idx AS hit_idx,
    CAST(round_even((m.us - o.us) / 1e6, 0) AS BIGINT) AS gap_seconds,
    array_to_string(list_sort(list_intersect(f.subject, m.toks))[1:4], '/') AS shared,
    substr(regexp_replace(m.text, '\\s+', ' ', 'g'), 1, 110) AS quote
  FROM fires1 f JOIN msgs o ON o.sid = f.sid AND o.idx = f.idx
    JOIN toks m ON m.sid = f.sid AND m.us > o.us AND m.key IN (SELECT key FROM markers)
      AND len(list_intersect(f.subject, m.toks)) >= 2
  WHERE f.rule IN ('R05', 'R06') ORDER BY f.sid, f.idx, f.rule, f.key, m.idx""",
    "auto4": """
  SELECT f.sid, f.idx, f.rule, f.key, count(m.sid) >= 3 OR coalesce(max(m.us) - any_value(o.us) >= 600000000, false) AS auto_label
  FROM fires1 f JOIN msgs o ON o.sid = f.sid AND o.idx = f.idx LEFT JOIN msgs m ON m.sid = f.sid AND m.us > o.us
  WHERE f.rule = 'R04' GROUP BY ALL""",
}


# read many times in one statement
SHARED = ("facts", "msgs", "stale", "asof_questions", "lost", "pairs", "ratios", "open_drafts", "fires", "fires1", "desync_last")


def query(select: str) -> str:
    """A complete statement: the views, then ``select``."""
    bodies = [f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({b})" for n, b in VIEWS.items()]
    return "WITH RECURSIVE " + ",\n".join(bodies) + "\n" + select.strip()


CAPTURES = f"""
bodies AS (SELECT conv_id, turn, row_number() OVER w AS n, string_agg(text, chr(10)) OVER w AS body
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
captures AS (SELECT CAST(conv_id AS VARCHAR) AS sid,
  conv_id, turn + 1 AS count,
  ['PreCompact', 'PostCompact', 'Stop', 'PostToolUse', 'SessionStart'][(conv_id + turn) % 5 + 1] AS event,
  {EPOCH_US} + conv_id * 60000000 + turn * 1000000 AS captured_us,
  CASE WHEN conv_id % 13 = 0 AND n = 2 THEN NULL WHEN conv_id % 11 = 0 AND n = 2 THEN ''
    WHEN conv_id % 7 = 0 AND n = 3 THEN '~' || body ELSE body END AS content FROM bodies),
listing AS (SELECT sid, conv_id, count, event, captured_us, content, content IS NOT NULL AS exists_,
  coalesce(strlen(content), 0) AS bytes, sha256(content) AS sha256,
  length(content) - length(replace(content, chr(10), ''))
    + CASE WHEN length(content) > 0 AND content NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines FROM captures),
edges AS (SELECT *, coalesce(last_value(CASE WHEN event IN ('PreCompact', 'PostCompact') THEN event END IGNORE NULLS)
  OVER (PARTITION BY sid ORDER BY count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'PreCompact', false) AS in_flight FROM listing),
plan AS (SELECT *, CASE WHEN NOT in_flight THEN run END AS epoch, event = 'PreCompact' AND NOT in_flight AS is_base FROM (
  SELECT *, coalesce(sum(CASE WHEN in_flight AND event = 'PostCompact' THEN 1 ELSE 0 END) OVER (PARTITION BY sid
    ORDER BY count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM edges)),
bases AS (SELECT DISTINCT ON (sid, epoch) sid, epoch, count AS base_count, bytes AS base_bytes, content AS base FROM plan
  WHERE epoch IS NOT NULL AND exists_ AND bytes > 0 ORDER BY sid, epoch, bytes DESC, count),
index_ AS (SELECT p.sid, p.conv_id, p.count, p.event, p.captured_us, p.bytes, p.epoch, p.in_flight, p.is_base, p.content, b.base, b.base_bytes,
  CASE WHEN NOT exists_ THEN 'missing' WHEN bytes = 0 THEN 'empty' WHEN in_flight THEN 'inflight'
    WHEN starts_with(b.base, p.content) THEN 'epoch' ELSE 'full' END AS source, p.sha256, p.lines, b.base_count
  FROM plan p LEFT JOIN bases b ON b.sid = p.sid AND b.epoch = p.epoch)
"""


def capture_query(select: str) -> str:
    return "WITH " + CAPTURES.strip() + "\n" + select.strip()
