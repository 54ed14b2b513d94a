"""Every registered query against its SQL equivalent."""

import re

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from conftest import SF
from tagspark.plans.catalog import all_queries

QUERIES = all_queries()
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert difference(df, con, ORACLES[name]) is None
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["idx", "term", "value"]
    assert df.count() > 0
