"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
import oracle_compare

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_compare.duck(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, message = oracle_compare.compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
    assert ok, message


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
