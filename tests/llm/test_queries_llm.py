"""Registered training-data queries against their SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from collections import namedtuple

from compare import compare, connect
from noteframe.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
Query = namedtuple("Query", "run sql")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    problem, count = compare(spark, con, Query(QUERIES[name], SQL[name]), SF)
    assert problem is None
    assert count > 0


def test_entry_point_registers_all():
    import __spark_entry__ as entry_point

    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
