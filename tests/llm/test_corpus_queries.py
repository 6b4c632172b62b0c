"""Every corpus query over the smallest tables: against its SQL, or for its columns."""

import pytest

import __spark_entry__ as driver
from check import database, difference
from notewright.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_operators_and_the_pipeline_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_a_document(spark, name):
    rows = QUERIES[name](spark, FOLDER).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
