"""Turn repair against the enumeration of all edits, a plain programme, and SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import pandas as pd
import pytest
from compare import assert_same
from conftest import SF_DIR
from pyspark.sql import functions as F

from turnscope.llm import turn_repair as R

LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
INSERTS = ["", "u", "a", "ua", "au"]


def kinds(rows):
    """(initial, must go, truncated) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        last = text.strip(R.BLANKS)[-1:]
        again = (role, text) in seen
        seen.add((role, text))
        out.append((role[:1] or " ", not last or again, bool(last) and not again and last not in ".!?"))
    return out


def enumerated(rows):
    """Least (cost, letters) over all edits with up to two inserted turns at every place."""
    options = []
    for initial, gone, cut in kinds(rows):
        own = [(4, "D", "")]
        if not gone:
            own += [(3 * cut, "K", initial), (3 + 3 * cut, "R", "u"), (3 + 3 * cut, "R", "a")]
        options.append(own)
    best = None
    for edits in itertools.product(*options):
        for added in itertools.product(INSERTS, repeat=len(rows) + 1):
            roles = added[0] + "".join(e[2] + a for e, a in zip(edits, added[1:]))
            if LEGAL.fullmatch(roles):
                letters = "I" * len(added[0]) + "".join(e[1] + "I" * len(a) for e, a in zip(edits, added[1:]))
                way = (sum(e[0] for e in edits) + 3 * sum(map(len, added)), letters)
                best = way if best is None or way < best else best
    return best


def planned(rows):
    """The same by the states of a plain forward programme."""
    ways = {"": (0, "")}
    step = lambda w, cost, letter: (w[0] + cost, w[1] + letter)
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    def widened(ways):
        more = dict(ways)
        for _ in range(2):
            for state, way in list(more.items()):
                new = step(way, 3, "I")
                more[due[state]] = min(more.get(due[state], new), new)
        return more

    for initial, gone, cut in kinds(rows):
        after = {}
        for state, way in widened(ways).items():
            found = [(state, step(way, 4, "D"))]
            if not gone:
                if initial == due[state] or (initial == "s" and state == ""):
                    found.append((initial, step(way, 3 * cut, "K")))
                found.append((due[state], step(way, 3 + 3 * cut, "R")))
            for to, new in found:
                after[to] = min(after.get(to, new), new)
        ways = after
    return min(way for state, way in widened(ways).items() if state in ("", "a"))


ROLES = ["user", "assistant", "system", "tool", ""]
TEXTS = ["ok.", "well", " ", "", "so?", "yes! \n"]


def conversations(rng, count, most):
    return [[(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, most))] for _ in range(count)]


def table(spark, talks):
    return spark.createDataFrame(
        [(c, t, role, text) for c, rows in enumerate(talks) for t, (role, text) in enumerate(rows)], SCHEMA)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cheapest_and_least_edits(spark, small_batches):
    rng = random.Random(4)
    talks = conversations(rng, 40, 3)
    got = {r.conv_id: (r.cost, r.audit) for r in R.summarise(R.repair(table(spark, talks))).collect()}
    assert got == {c: enumerated(rows) for c, rows in enumerate(talks) if rows}


def test_longer_conversations_and_their_texts(spark, small_batches):
    talks = conversations(random.Random(5), 60, 30)
    repaired = R.repair(table(spark, talks))
    got = {r.conv_id: (r.cost, r.audit) for r in R.summarise(repaired).collect()}
    assert got == {c: planned(rows) for c, rows in enumerate(talks) if rows}
    hashes = {r.conv_id: r.repaired_sha256 for r in R.summarise(repaired).collect()}
    bodies: dict = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.place)):
        if r.edit != "D":
            bodies.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, body in bodies.items():
        assert LEGAL.fullmatch("".join(role[:1] for role, _ in body))
        whole = "\n".join(f"{role}:{text}" for role, text in body)
        assert hashes[c] == hashlib.sha256(whole.encode()).hexdigest()


def test_one_conversation_of_many_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(ROLES[:3]), f"{i % 5000} {rng.choice(TEXTS)}") for i in range(20_000)]
    (got,) = R.summarise(R.repair(table(spark, [rows]))).collect()
    assert (got.cost, got.audit) == planned(rows)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(None, None, None, None, 1), (None, 1, "user", "hi.", 2), (1, 2, "assistant", "b.", 3), (1, None, "user", "a.", 4),
            (1, 2, "assistant", "a.", 5), (2, 0, "user", "x" * 300_000 + ".", 6), (2, 0, "user", "x" * 300_000 + ".", 7)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, kind long").withColumns({"place": F.lit("x"), "choice": F.lit("y")})
    got = {r.conv_id: r for r in R.summarise(R.repair(docs)).collect()}
    assert (got[None].blank, got[None].audit, got[None].gaps) == (1, "DKI", 0)
    assert (got[1].audit, got[1].illegal, got[1].gaps) == ("KKIK", 1, 0)  # the row without a turn, then text by text
    assert (got[2].duplicate, got[2].audit) == (1, "KDI")
    assert R.repair(table(spark, [])).count() == 0 and R.summarise(R.repair(table(spark, []))).count() == 0


def test_query_matches_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    frame = pd.DataFrame(
        [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice([*ROLES, None]),
          rng.choice([*TEXTS, "é?", None])) for _ in range(700)], columns=["conv_id", "turn", "role", "text"]
    ).astype({"conv_id": "Int64", "turn": "Int64"})
    frame.to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert_same(R.op11_turn_repair(spark, str(tmp_path)), con, R.SQL)


def test_query_matches_sql(spark, duck):
    assert_same(R.op11_turn_repair(spark, SF_DIR), duck, R.SQL)
