"""Every registered query against its SQL twin on DuckDB."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from tidemark.plans import catalog

QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    problem, n, _ = compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert not problem
    assert n >= 0


def test_every_query_has_a_sql_twin():
    assert set(QUERIES) == set(SQL)


def test_the_entry_offers_the_catalogue():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
