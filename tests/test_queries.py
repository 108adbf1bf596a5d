"""Every named query runs on the smallest data and gives the rows of its SQL on DuckDB."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) is None


def test_every_checked_query_exists():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
