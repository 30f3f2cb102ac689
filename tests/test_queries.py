"""Every registered query of the core beside its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from threadlake.plans import problem_queries, reference_queries, reference_sql, report_queries

QUERIES = {**problem_queries.QUERIES, **reference_queries.QUERIES, **report_queries.QUERIES}
SQL = {**problem_queries.SQL, **reference_sql.SQL, **report_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, same_as_sql):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark, same_as_sql):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
