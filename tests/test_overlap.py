"""Earliest overlapping set against a plain search, for short sets, long ones, and both."""

import random

import pytest
from pyspark.sql import functions as F

from turnscope.operators import overlap

ASKED = "sid string, ts string, seq bigint, us bigint, chunk string, idx bigint, rule string, key string, items array<string>"
SAID = "sid string, ts string, seq bigint, us bigint, chunk string, idx bigint, items array<string>"


def row(sid, second, idx, items, *rest):
    return (sid, f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}", idx, second * 1_000_000, None, idx, *rest, sorted(set(items)))


def tables(spark, asked, said):
    return [spark.createDataFrame(rows, schema).withColumn("chunk", F.lit(None)) for rows, schema in ((asked, ASKED), (said, SAID))]


def plain(asked, said):
    out = set()
    for a in asked:
        later = [(s[3], s[5]) for s in said if s[0] == a[0] and s[3] > a[3] and len(set(s[6]) & set(a[8])) >= 2]
        if later:
            out.add((a[0], a[5], a[6], a[7], *min(later)))
    return out


def found(asked, said, **options):
    rows = overlap.first_overlap(asked, said, **options).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("long", [1, 4, 100])
def test_against_plain_search(spark, long):
    rng = random.Random(long)
    names = [f"w{i}" for i in range(40)]
    items = lambda: rng.sample(names, rng.choice([0, 1, 2, 3, 4, 7, 12]))
    # many sets share an instant, and none of the same instant is later
    asked = [row(rng.choice("abc"), rng.randrange(30), i, items(), rng.choice(["R05", "R06"]), f"k{i}") for i in range(90)]
    said = [row(rng.choice("abd"), rng.randrange(30), 100 + i, items()) for i in range(60)]
    true = plain(asked, said)
    assert true
    assert found(*tables(spark, asked, said), long=long, block=8) == true


def test_long_sets_make_no_pairs(spark):
    names = [f"w{i:04d}" for i in range(1000)]
    asked = [row("s", 1, 1, names, "R05", "all"), row("s", 2, 2, names[:2], "R05", "two"), row("s", 9, 3, names, "R05", "late")]
    said = [row("s", 3, 11, names[5:6]), row("s", 4, 12, names[990:]), row("s", 5, 13, names)]
    a, s = tables(spark, asked, said)
    assert found(a, s) == {("s", 1, "R05", "all", 4_000_000, 12), ("s", 2, "R05", "two", 5_000_000, 13)}
    short = F.size("items") <= overlap.LONG
    assert overlap.by_pairs(a.where(short), s.where(short)).count() == 0


def test_nothing_to_compare(spark):
    asked, said = tables(spark, [row("s", 1, 1, ["a", "b"], "R05", "k")], [row("s", 2, 2, ["a", "b"])])
    assert found(asked, said.limit(0)) == set()
    assert found(asked.limit(0), said) == set()
    assert found(asked, said.withColumn("items", F.lit(None).cast("array<string>"))) == set()
