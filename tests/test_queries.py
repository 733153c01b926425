"""Every query of the core with SQL against that SQL; the others at least run."""

import importlib

import pytest

from tests.compare import connect, same

MODULES = [importlib.import_module(m) for m in ("benang.plans.problems", "benang.plans.reference")]
QUERIES = {n: q for m in MODULES for n, q in m.queries().items()}
SQL = {n: s for m in MODULES for n, s in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, con):
    same(QUERIES[name], SQL[name], spark, data, con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_point(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p6_found"} <= set(e.queries())


def test_core_does_not_need_llm():
    import os
    import re

    for folder, _, names in os.walk(os.path.dirname(importlib.import_module("benang").__file__)):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"^\s*(from|import)\s+benang\.llm", open(os.path.join(folder, n)).read(), re.M), n
