"""Conversation structure repair: the cheapest edits that give every conversation a legal sequence of roles.

Legal are role initials ``(s?(ua)+)?``. Secondary-sorted streaming: rows are dealt by conversation and sorted inside
their partition, so a conversation streams through one task in Arrow batches and is never held as a whole. The dynamic
programme runs from the last row to the first, because costs to go decide ties as well: per row it keeps what each of
four states costs from here on and passes the best edit of each state on as one byte beside the row. These compact
backpointers spill with the rows in Spark's own external sort; the second stream, from the first row on, follows them.
The state carried from batch to batch is four numbers one way, and the role state the other. A giant conversation
costs its task time, not memory: a digest over a conversation's whole text is sequential anyway.

Edits: K keep (free), R give the row the role of a user or assistant, D delete (what blank and duplicate rows need),
I insert an empty turn; a truncated row that stays costs extra. Among equally cheap edits the least in ASCII wins,
edit by edit, which is the least as a whole because each letter leads to one state.

Defined results: a null role or text is one space; an empty role is never legal; rows without a turn come first; rows of equal turn go by role, then
text; equal rows are duplicates of the first; null conversation ids form one conversation; empty tables give no rows;
a text of any length is one value, compared by its digest and never cut; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnscope.llm.checksum_sql import TABLE as CRC_TABLE
from turnscope.llm.checksum_sql import crc32

BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3  # costs
LETTERS = "DIKR"
SAID = ("user", "assistant")
# states by the last role so far: none, system, user, assistant
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEXT = (2, 2, 3, 2)  # the state after a user or assistant turn, whichever is due
END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("blank", "duplicate", "truncated")
KEY = ["no_conv", "conv"]


def step(togo: tuple, kind: int) -> tuple[tuple, int]:
    """Costs to go before a row of this kind, less their least, and the best letter of each state in two bits."""
    initial, gone, cut = "sua-"[kind & 3], kind & 4, TRUNCATED if kind & 8 else 0
    options = []
    for state, stay in enumerate(togo):
        found = {"D": DELETE + stay}
        if not gone:
            kept = AFTER[initial][state] if initial in AFTER else None
            if kept is not None:
                found["K"] = cut + togo[kept]
            found["R"] = REROLE + cut + togo[NEXT[state]]
        options.append(found)
    best = [min(found.values()) for found in options]
    for _ in range(2):
        best = [min(b, INSERT + best[NEXT[s]]) for s, b in enumerate(best)]
    for state, found in enumerate(options):
        found["I"] = INSERT + best[NEXT[state]]
    letters = [min(x for x in found if found[x] == best[s]) for s, found in enumerate(options)]
    choice = sum(LETTERS.index(x) << 2 * s for s, x in enumerate(letters))
    return tuple(b - min(best) for b in best), choice


def choices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the best edit of every state to rows that come last to first; the costs to go pass from batch to batch."""
    known: dict[tuple, tuple] = {}  # few differences between four costs are possible
    conversation, togo = None, END
    for rows in batches:
        chosen = []
        for no_conv, conv, kind in zip(rows.no_conv, rows.conv, rows.kind):
            if (no_conv, conv) != conversation:
                conversation, togo = (no_conv, conv), END
            if (togo, kind) not in known:
                known[togo, kind] = step(togo, kind)
            togo, choice = known[togo, kind]
            chosen.append(choice)
        yield rows.assign(choice=pd.Series(chosen, rows.index, dtype="int32"))


def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows first to last with their edits, inserted turns between; the role state passes from batch to batch."""
    conversation, state, place = None, 0, 0
    out: list[tuple] = []

    def emit(edit: str, turn, fault, was, role, text) -> None:
        nonlocal place
        out.append((*conversation, place, turn, fault, was, edit, role, text))
        place += 1

    def insert() -> None:
        nonlocal state
        emit("I", None, None, None, SAID[state == 2], "")
        state = NEXT[state]

    def finish() -> None:
        while conversation and state in (1, 2):
            insert()

    def taken() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=OUT, dtype=object)
        out.clear()
        return made

    for rows in batches:
        for no_conv, conv, turn, no_turn, role, text, fault, choice in zip(*(rows[c] for c in (
                *KEY, "turn", "no_turn", "role", "text", "fault", "choice"))):
            if (no_conv, conv) != conversation:
                finish()
                conversation, state, place = (no_conv, conv), 0, 0
            while (letter := LETTERS[choice >> 2 * state & 3]) == "I":
                insert()
            due = SAID[state == 2] if letter == "R" else role
            emit(letter, None if no_turn else int(turn), fault, role, due, text)
            if letter == "K":
                state = AFTER[role[0]][state]
            elif letter == "R":
                state = NEXT[state]
        yield taken()
    finish()
    yield taken()


OUT = [*KEY, "place", "turn", "fault", "was", "edit", "role", "text"]
OUT_TYPES = ("no_conv boolean, conv string, place long, turn long, fault string, was string, edit string, role string, "
             "text string")


def keyed(rows: DataFrame) -> list[Column]:
    """The conversation as text and whether it is null: pandas has no null among integers."""
    conv = rows["conv_id"].cast("string")
    return [conv.isNull().alias("no_conv"), F.coalesce(conv, F.lit("")).alias("conv")]


def unkeyed(rows: DataFrame) -> Column:
    return F.when(~F.col("no_conv"), F.col("conv")).cast(rows.schema["conv_id"].dataType).alias("conv_id")


def with_faults(messages: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with their first fault and what the programme has to know of them."""
    turn, blank = F.col("turn").cast("long"), F.lit(" ")
    rows = messages.select(
        *keyed(messages), F.coalesce(turn, F.lit(0)).alias("turn"), turn.isNull().alias("no_turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).repartition(*KEY)
    said_before = F.row_number().over(
        Window.partitionBy(*KEY, "role", F.md5("text")).orderBy(F.desc("no_turn"), "turn")) > 1
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = (F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(*".!?"), "truncated"))
    initial = F.substring("role", 1, 1)
    kind = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0))
    return rows.withColumn("again", said_before).withColumn("fault", fault).withColumn("kind", kind)


def repair(messages: DataFrame) -> DataFrame:
    """conv_id, place, turn, fault, was (the role before), edit, role, text of every row and inserted turn.

    Deleted rows are listed with edit D. The rows of a conversation lie in one partition, one after another in order.
    """
    order = [F.desc("no_turn"), F.asc("turn"), F.asc("role"), F.asc("text"), F.asc("again")]
    back = [F.asc("no_turn"), F.desc("turn"), F.desc("role"), F.desc("text"), F.desc("again")]
    rows = with_faults(messages)
    chosen = rows.sortWithinPartitions(*KEY, *back).mapInPandas(choices, f"{rows._jdf.schema().toDDL()}, choice int")
    edited = chosen.sortWithinPartitions(*KEY, *order).mapInPandas(follow, OUT_TYPES)
    return edited.select(unkeyed(messages), *OUT[2:])


class Summary:
    """One conversation's figures, gathered row by row."""

    def __init__(self):
        self.counts = dict.fromkeys(FAULTS, 0)
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.audit, self.digest, self.begun = bytearray(), hashlib.sha256(), False

    def add(self, turn, fault, was, edit, role, text) -> None:
        self.audit += edit.encode()
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "D":
            self.cost += TRUNCATED * (fault == "truncated")
            self.digest.update(f"{chr(10) * self.begun}{role}:{text}".encode())
            self.begun = True
        if edit == "I":
            return
        if fault:
            self.counts[fault] += 1
        if self.before is not None:
            self.illegal += self.before + was[:1] not in ("su", "ua", "au")
        self.before = was[:1]
        if not pd.isna(turn):
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn

    def row(self) -> tuple:
        gaps = 0 if self.first is None else int(self.last - self.first) + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation from its edited rows in order."""
    conversation, summary = None, None
    names = [*KEY, *(f.split()[0] for f in FIGURES.split(", "))]
    for rows in batches:
        done = []
        for no_conv, conv, turn, *rest in zip(*(rows[c] for c in (
                *KEY, "turn", "fault", "was", "edit", "role", "text"))):
            if (no_conv, conv) != conversation:
                if summary:
                    done.append((*conversation, *summary.row()))
                conversation, summary = (no_conv, conv), Summary()
            summary.add(None if turn is None else int(turn), *rest)
        yield pd.DataFrame(done, columns=names)
    if summary:
        yield pd.DataFrame([(*conversation, *summary.row())], columns=names)


def summarise(repaired: DataFrame) -> DataFrame:
    """Figures per conversation; reads the partitions of ``repair`` as they lie."""
    rows = repaired.select(*keyed(repaired), F.col("turn").cast("string").alias("turn"), *OUT[4:])
    return rows.mapInPandas(summaries, f"no_conv boolean, conv string, {FIGURES}").select(
        unkeyed(repaired), *(f.split()[0] for f in FIGURES.split(", ")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, blank).alias(c) for c in ("role", "text")),
                                (F.crc32(name) % 20).alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
        F.col("text"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = summarise(repair(damaged(given)))
    every = given.select(F.col("conv_id").alias("every_id")).distinct()
    names = [f.split() for f in FIGURES.split(", ")]
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every_id").alias("conv_id"),
        *(F.coalesce(c, empty.get(c, F.lit(0))).cast(t).alias(c) for c, t in names))


def _sql() -> str:
    """Forward dynamic programme: a state's best way is nine digits of cost and the letters so far, compared as text."""
    more = lambda c, cost, letter: (
        f"(lpad(CAST(CAST(left({c}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({c}, 10) || '{letter}')")
    widened = [f"c{s}" if s < 2 else
               f"least(c{s}, {', '.join(more(c, INSERT, 'I') for c in (('c0', 'c1', 'c3') if s == 2 else ('c2',)))})"
               for s in range(4)]
    cut = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    into = {1: (("c0", "s"),), 2: (("c0", "u"), ("c1", "u"), ("c3", "u")), 3: (("c2", "a"),)}

    def taken(state: int) -> str:
        ways = [more(f"c{state}", DELETE, "D")]
        for source, initial in into.get(state, ()):
            ways.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {more(source, cut, 'K')} END")
            if initial != "s":
                ways.append(f"CASE WHEN NOT gone THEN {more(source, f'{REROLE} + {cut}', 'R')} END")
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    return f"""
WITH RECURSIVE {CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) AS copies(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)),
placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time_said,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN time_said > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
judged AS (SELECT *, fault IN ('blank', 'duplicate') AS gone FROM faulty),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS c0, CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS VARCHAR) AS c2,
    CAST(NULL AS VARCHAR) AS c3 FROM judged
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{taken(s)} AS c{s}' for s in range(4))}
  FROM (SELECT w.conv_id, j.i, j.initial, j.gone, j.fault, {', '.join(f'{x} AS c{s}' for s, x in enumerate(
      w.replace('c0', 'w.c0').replace('c1', 'w.c1').replace('c2', 'w.c2').replace('c3', 'w.c3') for w in widened))}
    FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)),
best AS (
  SELECT conv_id, least(c0, c3, {more('c2', INSERT, 'I')}, {more('c1', 2 * INSERT, 'II')}) AS way
  FROM (SELECT conv_id, c0, c1, c2, c3, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS r FROM ways) WHERE r = 1),
letters AS (
  SELECT conv_id, k, substr(way, 9 + CAST(k AS BIGINT), 1) AS letter FROM best, range(1, 100000) AS places(k)
  WHERE k <= length(way) - 9),
counted AS (
  SELECT conv_id, k, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS m
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
edited AS (
  SELECT c.conv_id, c.k, c.letter, c.m, j.role, CASE WHEN c.letter = 'I' THEN '' ELSE j.text END AS text,
    max(CASE WHEN c.m = 1 AND c.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS opened
  FROM counted c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i AND c.letter <> 'I'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY k) AS body FROM edited WHERE letter <> 'D' GROUP BY conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged) GROUP BY conv_id)
SELECT g.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
  coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(CAST(left(b.way, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(b.way, 10), '') AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM g.conv_id
"""


SQL = _sql()
