"""Every bound query against its SQL, planned as if no table were small enough to broadcast."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: fn for registry in entry._ALL for name, fn in registry.queries.items()}
ORACLES = entry.oracle_sql()
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEvalPython")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(no_broadcast, duck, name):
    df = QUERIES[name](no_broadcast, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    assert spark_rows(df) == duck_rows(duck, ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
