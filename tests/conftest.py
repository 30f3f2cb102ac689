"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from threadlake.session import Staging, get_spark

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 8, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def fixed_partitions(spark):
    """Small inputs keep their shuffle partitions, so that runs and sessions cross partition edges."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="session")
def same_as_sql(spark):
    if not SMALL.is_dir():
        pytest.skip("no test tables")
    import duckdb

    from verify import canon

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")

    def check(query, sql: str) -> None:
        with Staging(spark):
            df = query(spark, str(SMALL))
            cols = sorted(df.columns)
            got = sorted(tuple(map(canon, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())

    return check
