"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from check import compare

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(name, spark, duck_connection, sf_dir):
    problem, _ = compare(spark, duck_connection, QUERIES[name], SQL[name], sf_dir)
    assert problem is None, problem
