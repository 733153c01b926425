"""Every query of the subpackage: with SQL against it, the others at least run."""

import pytest

from benang.llm import queries as Q
from tests.compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(name, spark, data, con):
    same(Q.queries()[name], Q.oracle_sql()[name], spark, data, con)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(name, spark, data):
    assert Q.queries()[name](spark, data).count() >= 0
