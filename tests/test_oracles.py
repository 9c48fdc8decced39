"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from oracles import ORACLES
from registered import QUERIES
from tests.support import DATA, oracle_connection, oracle_kinds, oracle_rows, spark_kinds, spark_rows

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


# Their gate is a nested-loop join against at most one row.
GATES = {"nearby_with_fallback", "nearby_without_fallback"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = driver.oracle_sql()[name]
    result = driver.queries()[name](spark, SF)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "ArrowEval" not in plan
    assert name in GATES or "NestedLoopJoin" not in plan
    assert spark_kinds(result) == oracle_kinds(con, sql)
    assert spark_rows(result) == oracle_rows(con, sql)


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 1 and rows[0].passed and rows[0].row_count > 0
