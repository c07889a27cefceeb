"""Queries that evaluate and carry only what decides their result, against SQL and against the full forms."""

import difflib
import random

import pytest
from compare import assert_same
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_queries import PLANS, SQL

from turnscope import registry
from turnscope.operators import rules, similar, verdicts
from turnscope.session import materialize
from turnscope.sources import catalogue as C


@pytest.mark.parametrize("name", ["label_r10", "pending_resolution", "fires_summary"])
def test_other_fires_are_not_written(spark, duck, name):
    tables = registry.Tables(spark, SF_DIR)
    assert_same(PLANS[name](tables), duck, SQL[name])
    assert not {"fires", "first_fires", "fire_log", "routed"} & set(vars(tables))


def test_label_r10_reads_messages_only(spark):
    tables = registry.Tables(spark, SF_DIR)
    PLANS["label_r10"](tables)
    assert not rules.state.is_marked(tables.log)


@pytest.mark.parametrize("name", ["labelled_fires", "fire_list", "catalogue_drift"])
def test_labels_read_causes_without_wording(spark, duck, name):
    tables = registry.Tables(spark, SF_DIR)
    assert_same(PLANS[name](tables), duck, SQL[name])
    assert not {"fires", "first_fires"} & set(vars(tables))
    filled = tables.causes.groupBy("rule").agg(F.count("why"), F.count("detail"), F.count("subject")).collect()
    assert {r.rule for r in filled if r[1]} == set()
    assert {r.rule for r in filled if r[2]} <= {"R07"}
    assert {r.rule for r in filled if r[3]} == {"R05", "R06"}


def test_only_rules_that_may_ask(spark):
    assert sorted(C.asking_rules(C.packaged(spark))) == ["R04", "R07", "R10"]
    none = rules.evaluate(registry.Tables(spark, SF_DIR).inputs, only=[])
    assert none.columns == rules.FIRE and none.count() == 0


def test_branches_read_their_folder(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n long, kind string").withColumn("void", F.lit(None))
    back = materialize(rows, "kinds", "kind")
    assert back.columns == rows.columns and sorted(back.collect()) == sorted(rows.collect())
    plan = registry.Tables(spark, SF_DIR).share().messages._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_marked_keys_are_those_of_markers(spark):
    writes = spark.createDataFrame(
        [("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 3, True), ("c", 5, None), ("d", 1, True), ("d", 2, None), (None, 9, True)],
        "key string, ord long, desync boolean")
    expected = sorted(r.key for r in verdicts.markers(writes).collect())
    assert sorted(r.key for r in verdicts.marked_keys(writes).collect()) == expected == ["b"]


def test_what_is_sure_is_alike():
    rng = random.Random(6)
    sure = 0
    for _ in range(3000):
        n = rng.choice([0, 1, 5, 30, 120, 198, 199, 200, 260])
        a = "".join(rng.choice("abc ") for _ in range(n))
        b = a[: rng.randint(0, n)] + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 20)))
        a, b = rng.choice([(a, b), (b, a), (a[::-1], b[::-1])])
        for threshold in (0.55, 0.7, 0.85):
            if a != b and similar.surely_alike(a, b, threshold):
                sure += 1
                assert difflib.SequenceMatcher(None, b, a).ratio() >= threshold
    assert sure > 1000
    assert not similar.surely_alike("x" * 199 + "y", "x" * 199 + "z", 0.55)


def test_the_measure_is_spared_where_a_beginning_decides():
    measure = similar.Measure(0.55)
    a, b = similar.Texts(["look at case 17 please"]), similar.Texts(["look at case 18 please", "nothing of the kind"])
    measure.matcher.set_seq1 = None  # a call would raise
    assert measure.alike(a, b, *map(similar.np.array, ([0], [0]))).tolist() == [True]


def test_only_listed_fires_are_labelled(spark, duck):
    tables = registry.Tables(spark, SF_DIR)
    assert_same(PLANS["fire_list"](tables), duck, SQL["fire_list"])
    assert not {"causes", "labelled"} & set(vars(tables))
    assert tables.listed.groupBy("rule").count().agg(F.max("count")).head()[0] == 25
