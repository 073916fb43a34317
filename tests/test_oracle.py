"""Every query with oracle SQL gives the oracle's rows on the smallest scale; a second run gives the same."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_oracle(spark, con, tiny, name):
    assert compare(spark, con, tiny, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not re.match(r"p[0-9]_", n)))
def test_queries_without_oracle_are_deterministic(spark, tiny, name):
    one, two = (sorted(map(str, QUERIES[name](spark, tiny).collect())) for _ in range(2))
    assert one == two


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
