"""Every query with a SQL twin agrees with it on whole tables; the rest return rows."""

import pytest

from tabwright.queries import load
from tests.conftest import SMALL
from tests.oracle import compare, connect

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_has_query():
    assert set(SQL) <= set(QUERIES)
