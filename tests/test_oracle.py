"""Every showcase query against its SQL in DuckDB, on whole tables."""

import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, DIRECTORY)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert difference(result, duck, sql) is None


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows
    found = {(r.left_dataset, r.left_column, r.right_dataset, r.right_column) for r in rows}
    for pair in (
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_custkey", "orders", "o_custkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ):
        assert pair in found
