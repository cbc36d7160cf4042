"""All queries of the subpackage run; those with SQL give its rows. None of the core imports it."""

import re
from pathlib import Path

import pytest
from oracles import DATA, check, database

import verdigraph
from verdigraph.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    check(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_nothing_imports_it():
    root = Path(verdigraph.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"verdigraph\.llm|from verdigraph import llm", path.read_text())
