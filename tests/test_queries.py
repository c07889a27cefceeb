"""Every registered query against its SQL statement, and every SQL statement against a query."""

import pytest
from compare import assert_same
from conftest import SF_DIR

from turnscope import registry
from turnscope.oracle.statements import oracle_sql

PLANS = {name: plan for group in registry.GROUPS for name, plan in group.items()}
SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables(spark):
    return registry.Tables(spark, SF_DIR).share()


def test_every_query_has_a_statement():
    assert set(SQL) == set(PLANS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(tables, duck, name):
    assert_same(PLANS[name](tables), duck, SQL[name])
