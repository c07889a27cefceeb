"""The same answers when every session is cut into chunks."""

import pytest
from compare import assert_same
from conftest import SF_DIR
from test_queries import PLANS, SQL

from turnscope import registry
from turnscope.plans.ordered import is_chunked

NAMES = [
    "presend_counts", "stale_tasks", "questions_asof", "state_facts", "rule_r02", "rule_r04", "rule_r07", "rule_r08",
    "rule_r12", "ordered_events", "epoch_plan", "capture_deltas", "fire_routing", "later_correction", "label_r04",
    "previous_turn", "systematic_sample",
]


@pytest.fixture
def tables(spark, hot):
    return registry.Tables(spark, SF_DIR).share()


def test_sessions_are_chunked(tables):
    assert is_chunked(tables.log)
    assert tables.log.where("chunk IS NOT NULL").count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_when_hot(tables, duck, name):
    assert_same(PLANS[name](tables), duck, SQL[name])
