"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    message, _, _, rows = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert not message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert not contract.entry(spark).isEmpty()
