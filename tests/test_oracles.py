import pytest

from credence.plans import oracles, queries
from tests.oracle import SF, connect, same

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ok, got, want = same(queries.queries()[name](spark, SF), con, SQL[name])
    assert got[1] == want[1]
    assert ok, [x for x in zip(got[0], want[0]) if x[0] != x[1]][:3]
    assert got[0]
