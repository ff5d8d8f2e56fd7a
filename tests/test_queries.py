"""Every registered query of the library itself against its SQL, over whole tables."""

import pytest

from oracle import connection, same
from quarry.plans import registry

from conftest import DATA

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


def test_each_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    left, right = same(QUERIES[name](spark, DATA), con, ORACLES[name])
    assert left == right


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["ticket_id", "team", "code_rca_eligible", "match_basis"]
    assert out.count() == 200
