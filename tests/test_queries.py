"""Every registered query of the core against its SQL."""

import pytest

from tests.oracle import SF, connect, rows
from tidemark.plans.workflows import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry_registers_core_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 19


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["i4_value_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_discount:double>" in plan


def test_distribution_gathers_no_group_in_a_task(spark, duck):
    found = QUERIES["a3_distribution"](spark, SF)
    assert " percentile(" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.toPandas()) == rows(duck.sql(ORACLES["a3_distribution"]).df())
