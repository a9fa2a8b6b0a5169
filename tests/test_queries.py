"""Every registered query that has SQL agrees with it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, name):
    assert compare(entry.queries()[name](spark, SMALL), tables, SQL[name]) is None


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
