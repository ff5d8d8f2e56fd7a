"""The queries that SQL can express, over whole tables."""

import pytest

from conftest import DATA
from oracle import connection, same
from quarry.llm import queries as Q


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, con, name):
    left, right = same(Q.queries()[name](spark, DATA), con, Q.oracle_sql()[name])
    assert left == right


def test_eleven_queries():
    names = [n.split("_")[0] for n in Q.queries()]
    assert sorted(names) == sorted([f"op{n}" for n in range(1, 11)] + ["pipeline"])
