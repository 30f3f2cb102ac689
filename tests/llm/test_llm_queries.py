"""The subpackage's registered queries beside their SQL, and that nothing else needs the subpackage."""

from __future__ import annotations

from pathlib import Path

import pytest

import threadlake
from threadlake.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, same_as_sql):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(threadlake.__file__).parent
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            assert "threadlake.llm" not in f.read_text()
