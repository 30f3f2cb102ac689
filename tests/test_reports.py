"""Report scalars on hand-written cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadlake.operators import reports
from threadlake.operators.transcripts import short_id


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    now = 1_000_000_000
    for back, want in ((5_000, "just now"), (59_999, "just now"), (60_000, "1m ago"), (3_600_000, "1h ago"), (200_000_000, "2d ago")):
        assert one(spark, reports.relative_time(F.lit(now - back), now)) == want
    assert one(spark, reports.relative_time(F.lit(None).cast("bigint"), now)) is None
    assert [one(spark, reports.duration_text(F.lit(x))) for x in (12.0, 999.0, 1000.0, 12345.0)] == ["12ms", "999ms", "1.0s", "12.3s"]
    assert one(spark, reports.html_escape(F.lit('<a b="c">&'))) == "&lt;a b=&quot;c&quot;&gt;&amp;"
    h = 0
    for c in "threadlake é":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, reports.rolling_hash(F.lit("threadlake é"))) == h
    assert one(spark, reports.rolling_hash(F.lit(""))) == 0
    assert one(spark, short_id(F.lit("01234567-89ab-cdef-0123-456789abcdef"))) == "01234567"
    assert one(spark, short_id(F.lit("no uuid"))) == "no uuid"


def test_dates(spark):
    day = dt.date(2026, 3, 4)  # a Wednesday
    text = one(spark, reports.expand_dates(F.lit("a={{today}}&b={{today-7d}}&c={{start_of_year}}&d={{start_of_month}}&e={{other}}"), day))
    assert text == "a=2026-03-04&b=2026-02-25&c=2026-01-01&d=2026-03-01&e={{other}}"
    assert reports.date_preset("week", day) == ("2026-03-01", "2026-03-04")
    assert reports.date_preset("week", dt.date(2026, 3, 1)) == ("2026-03-01", "2026-03-01")
    assert reports.date_preset("month", day)[0] == "2026-03-01"


def test_projects(spark):
    dirs = spark.createDataFrame([("/w/a/b/c/",), ("/w/x/y",), ("/z/q",), ("  ",), (None,), ("/w/x/y",)], "cwd string")
    marks = spark.createDataFrame([("/w/a/b", "git"), ("/w/a", "agent"), ("/w", "agent"), ("/w/x/y", "git")], "dir string, kind string")
    got = {r.cwd: r.project for r in reports.resolve_projects(dirs, marks).collect()}
    assert got == {"/w/a/b/c/": "a", "/w/x/y": "w", "/z/q": "q"}
    assert {r.cwd: r.project for r in reports.resolve_projects(dirs, marks.where("kind = 'git'")).collect()} == {"/w/a/b/c/": "b", "/w/x/y": "y", "/z/q": "q"}


def test_grades(spark):
    assert [one(spark, reports.grade(F.lit(x), 0.9)) for x in (0.95, 0.9, 0.85, 0.5)] == ["pass", "pass", "close", "fail"]
    assert [one(spark, reports.grade(F.lit(x), 100.0, False)) for x in (90.0, 105.0, 120.0)] == ["pass", "close", "fail"]


def test_empty_tables(spark):
    s = spark.createDataFrame([], "id string, project string, date string, title string, summary string, tags array<string>, entities array<string>, questions array<string>, enriched_at bigint, enrichment_version int")
    assert reports.summary_header(s).count() == 0
    assert reports.question_rows(s).count() == 0
    assert reports.enrich(s, s.select("id", "title", "summary"), 3, 0).count() == 0
    assert reports.seeded_sample(s, "id", 3, 1).count() == 0
