"""Every query against its SQL on the smallest tables, and what its plan must not contain."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from checks import ORACLES, QUERIES
from checks.compare import database, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not there")


@pytest.fixture(scope="module")
def sql():
    return database(FOLDER)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert entry_point.queries().keys() >= entry_point.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert node not in plan
    found = df.toArrow()
    if name in ORACLES:
        assert difference(found, sql.sql(ORACLES[name]).to_arrow_table()) is None
