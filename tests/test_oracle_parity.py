"""Every key with a SQL twin matches DuckDB on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from churnscope.parity import compare
from conftest import SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_key_is_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck_small, name):
    ok, msg = compare(QUERIES[name](spark, SMALL), duck_small, SQL[name])
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["city", "rate_7", "rate_14", "rate_21"]
    assert df.count() > 0
