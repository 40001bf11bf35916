"""Every registered query with SQL gives the rows of that SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, db, name):
    assert differences(QUERIES[name](spark, sf_dir), db, SQL[name]) is None


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
