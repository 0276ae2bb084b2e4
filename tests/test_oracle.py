"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from conftest import SF_SMALL
from oracle.compare import compare, connect
from oracle.registry import all_sql
from viewlens.plans.registry import all_queries

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    diff = compare(df.columns, got, rel.columns, rel.fetchall())
    assert diff is None, diff
