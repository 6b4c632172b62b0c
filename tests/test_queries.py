"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from check import database, difference
from workload.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = driver.queries()[name](spark, FOLDER)
    assert difference(df, con, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bullet_lines", "vocab_anchor", "title_scope", "top_entries", "collect_memories", "redact"])
def test_plans_hold_no_cross_join_or_python(spark, name):
    plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("Cartesian", "NestedLoop", "Python", "Pandas"):
        assert word not in plan


def test_caps_cut_before_the_shuffle(spark):
    plan = driver.queries()["top_entries"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("hashpartitioning(project_id") < plan.index("Partial")
