"""Browsing sessions: filters, pages, status, heatmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_between(col: str = "date", lo: str | None = None, hi: str | None = None, day: str | None = None) -> Column:
    """Text comparison, both ends included; a single day overrides the bounds."""
    if day is not None:
        lo = hi = day
    c = F.lit(True)
    if lo is not None:
        c = c & (F.col(col) >= lo)
    if hi is not None:
        c = c & (F.col(col) <= hi)
    return c


def like_folded(value: Column, part: str) -> Column:
    """Substring test in lower case; ``%`` and ``_`` in ``part`` are wildcards, a backslash is itself."""
    return F.lower(value).like("%" + part.lower().replace("\\", "\\\\") + "%")


def has_tag(part: str, tags: str = "tags") -> Column:
    """True where an element of ``tags`` holds ``part``; null lists never match."""
    return F.coalesce(F.exists(tags, lambda t: F.coalesce(like_folded(t, part), F.lit(False))), F.lit(False))


def page(sessions: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of sessions, newest first by last message, else by indexing; ids break ties. At most 100 rows."""
    order = [F.coalesce("last_message_at", "indexed_at").desc(), F.col("id")]
    return sessions.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def status(sessions: DataFrame, chunks: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of counts."""
    s = sessions.agg(F.count("*").alias("sessions"), F.max("indexed_at").alias("last_indexed_at"), F.count("enriched_at").alias("enriched"))
    c = chunks.agg(F.count("*").alias("chunks"))
    a = audit.agg(F.count("*").alias("searches"))
    return s.crossJoin(c).crossJoin(a).withColumn("pending", F.col("sessions") - F.col("enriched"))  # one row each


def projects(sessions: DataFrame) -> DataFrame:
    """Projects with their newest date; blanks left out."""
    return sessions.where(F.coalesce(F.col("project"), F.lit("")) != "").groupBy("project").agg(F.max("date").alias("last_date"), F.count("*").alias("n"))


def daily(sessions: DataFrame, hours: bool = False) -> DataFrame:
    """``date, value``: sessions, or hours to one decimal, per day."""
    value = F.round(F.sum(F.coalesce("duration_seconds", F.lit(0))) / 3600, 1) if hours else F.count("*").cast("double")
    return sessions.where(F.coalesce(F.col("date"), F.lit("")) != "").groupBy("date").agg(value.alias("value"))


def filled_calendar(days: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Every day from ``lo`` to ``hi`` with its value, 0 where there is none; an end that isn't given is that of ``days``. What is no date is left out."""
    ends = days.agg(F.min(F.col("date").try_cast("date")).alias("lo"), F.max(F.col("date").try_cast("date")).alias("hi"))  # one row
    lo_, hi_ = (F.lit(x).cast("date") if x else F.col(c) for x, c in ((lo, "lo"), (hi, "hi")))
    cal = ends.where(lo_.isNotNull() & hi_.isNotNull()).select(F.explode(F.sequence(lo_, hi_)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    return cal.join(days, "date", "left").fillna(0, ["value"])


def intensity(days: DataFrame) -> DataFrame:
    """Levels 0 to 4 by quarters of the largest value."""
    top = days.agg(F.max("value").alias("top"))
    share = F.col("value") / F.col("top")
    level = F.when(F.coalesce("value", F.lit(0)) <= 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return days.crossJoin(top).select("date", "value", level.alias("level"))  # top is one row


def weekly(sessions: DataFrame) -> DataFrame:
    """``week`` (its Monday), ``project``, sessions; and the axis end, a multiple of five."""
    week = F.date_format(F.date_trunc("week", F.to_timestamp("date", "yyyy-MM-dd")), "yyyy-MM-dd")
    per = sessions.where("date != ''").groupBy(week.alias("week"), "project").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("week"))
    return per.withColumn("week_total", total).withColumn("axis_max", F.greatest(F.ceil(F.col("week_total") / 5) * 5, F.lit(5)))


def heatmap_totals(days: DataFrame) -> DataFrame:
    """Sum of the (already rounded) daily values and the number of active days."""
    return days.agg(F.round(F.sum("value"), 1).alias("total"), F.count_if(F.col("value") > 0).alias("active_days"))


def distinct_items(sessions: DataFrame, col: str = "tags") -> DataFrame:
    return sessions.select(F.explode(col).alias("item")).where("trim(item) != ''").distinct()
