"""Small reports and scalars around sessions, searches and measures; all are JVM expressions and combining aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import is_blank


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- scalars


def relative_time(ms: Column | str, now_ms: int) -> Column:
    """``just now``, minutes, hours or days ago."""
    diff = F.floor((F.lit(now_ms) - _col(ms)) / 1000)

    def ago(unit: int, mark: str) -> Column:
        return F.concat(F.floor(diff / unit).cast("string"), F.lit(f"{mark} ago"))

    return F.when(diff < 60, "just now").when(diff < 3600, ago(60, "m")).when(diff < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def duration_text(ms: Column | str) -> Column:
    """Milliseconds below a second, else seconds with one decimal."""
    c = _col(ms)
    tenths = F.round(c / 100).cast("bigint")
    return F.when(c < 1000, F.concat(F.round(c).cast("bigint").cast("string"), F.lit("ms"))).otherwise(
        F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    )


def rolling_hash(name: Column | str) -> Column:
    """The 32-bit rolling hash (factor 31) that gives a name its colour slot."""
    letters = F.filter(F.split(_col(name), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(1 << 32)))


def html_escape(text: Column | str) -> Column:
    c = _col(text)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def fingerprint(*parts: Column | str) -> Column:
    """Sixteen hex digits of SHA-256 over the parts: a cache key."""
    return F.substring(F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256), 1, 16)


def expand_dates(text: Column | str, today: dt.date) -> Column:
    """Date templates in double braces: today, today-7d and the like (7, 28, 30, 90), start_of_year, start_of_month."""
    c = _col(text)
    days = {"today": today, "start_of_year": today.replace(month=1, day=1), "start_of_month": today.replace(day=1)}
    days |= {f"today-{n}d": today - dt.timedelta(days=n) for n in (7, 28, 30, 90)}
    for name, day in days.items():
        c = F.replace(c, F.lit("{{" + name + "}}"), F.lit(day.isoformat()))
    return c


def date_preset(name: str, today: dt.date) -> tuple[str, str]:
    """Bounds of ``today``, ``week`` (from Sunday) or ``month``, each up to today."""
    start = {"today": today, "week": today - dt.timedelta(days=(today.weekday() + 1) % 7), "month": today.replace(day=1)}[name]
    return start.isoformat(), today.isoformat()


def grade(value: Column | str, target: float, higher_better: bool = True) -> Column:
    """``pass``, ``close`` (within seven percent of the target) or ``fail``."""
    c = _col(value)
    ok, close = (c >= target, c >= target * 0.93) if higher_better else (c <= target, c <= target * 1.07)
    return F.when(ok, "pass").when(close, "close").otherwise("fail")


# ---- sessions


def resolve_projects(dirs: DataFrame, markers: DataFrame, dir_col: str = "cwd") -> DataFrame:
    """``cwd, project``: the nearest directory at or above ``cwd`` that holds an ``agent`` marker, else a ``git`` one, else the last part.

    ``markers`` has ``dir, kind``. Each directory is exploded into its ancestors, which meet the markers in an equi-join.
    Blank directories are left out; trailing slashes don't count.
    """
    clean = dirs.where(~is_blank(dir_col)).select(F.col(dir_col).alias("cwd"), F.regexp_replace(dir_col, "/+$", "").alias("d")).distinct()
    parts = F.split("d", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    steps = clean.select("cwd", "d", F.explode(above).alias("dir"))
    rank = F.struct(F.when(F.col("kind") == "agent", 1).otherwise(0), F.length("dir"))
    best = steps.join(markers.select("dir", "kind").distinct(), "dir", "left").groupBy("cwd", "d").agg(F.max_by(F.when(F.col("kind").isNotNull(), F.col("dir")), F.when(F.col("kind").isNotNull(), rank)).alias("dir"))
    return best.select("cwd", F.element_at(F.split(F.coalesce("dir", "d"), "/"), -1).alias("project"))


def line_texts(blocks: DataFrame) -> DataFrame:
    """``line_id, text, thinking, n_tools, only_results`` of each line with blocks: its text blocks joined by line breaks, thinking apart.

    Only blocks of the line itself count, not those within results. A line of results only is no turn of a user.
    """
    top = blocks.where("depth = 0")

    def joined(kind: str) -> Column:
        places = F.array_sort(F.collect_list(F.when((F.col("block_type") == kind) & (F.col("body") != ""), F.struct("position", "body"))))  # blocks of one line
        return F.array_join(F.transform(places, lambda x: x["body"]), "\n")

    return top.groupBy("line_id").agg(
        joined("text").alias("text"), joined("thinking").alias("thinking"), F.count_if(F.col("block_type") == "tool_use").alias("n_tools"),
        (F.count_if(F.col("block_type") == "tool_result") == F.count("*")).alias("only_results"),
    )


def summary_header(sessions: DataFrame) -> DataFrame:
    """``id, header``: the Markdown head of a rendered session that has a summary."""

    def listed(label: str, col: str) -> Column:
        items = F.coalesce(col, F.array().cast("array<string>"))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(items, ", "), F.lit("\n"))).otherwise("")

    lists = F.concat(listed("Tags", "tags"), listed("Entities", "entities"))
    head = F.concat(F.lit("## Summary\n\n"), F.col("summary"), F.lit("\n\n"), lists, F.when(lists != "", "\n").otherwise(""), F.lit("---\n"))
    return sessions.where("summary != ''").select("id", head.alias("header"))


def enrich(stored: DataFrame, replies: DataFrame, version: int, at_ms: int) -> DataFrame:
    """Sessions with the fields of their reply (``id, title, summary, tags, …``); a title is only replaced by a non-empty one."""
    fields = [c for c in ("summary", "tags", "entities", "learnings", "questions") if c in replies.columns]
    new = replies.select("id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in ("title", *fields)])
    is_new = F.coalesce("_new", F.lit(False))
    given = {c: F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    given["title"] = F.when(is_new & (F.col("_title") != ""), F.col("_title")).otherwise(F.col("title"))
    given["enriched_at"] = F.when(is_new, F.lit(at_ms)).otherwise(F.col("enriched_at"))
    given["enrichment_version"] = F.when(is_new, F.lit(version)).otherwise(F.col("enrichment_version")).cast(stored.schema["enrichment_version"].dataType)
    return stored.join(new, "id", "left").select(*[given.get(c, F.col(c)).alias(c) for c in stored.columns])


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A sampling operator: ``n`` rows in an order fixed by md5 of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def filled_up(rows: DataFrame, chosen: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``chosen`` and ``n`` more rows under the next seed."""
    return chosen.unionByName(seeded_sample(rows.join(chosen.select(key), key, "left_anti"), key, n, seed + 1))


# ---- searches and measures


def audit_entries(found: DataFrame, asked: DataFrame) -> DataFrame:
    """One entry per search: ``query_id, result_count, top_id, top_score``; searches without a result count 0."""
    best = found.groupBy("query_id").agg(F.count("*").alias("result_count"), F.min_by("doc_id", "rk").alias("top_id"), F.min("rank").alias("top_score"))
    return asked.select("query_id").join(best, "query_id", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0)))


def audit_totals(audit: DataFrame, by: str) -> DataFrame:
    """Searches, empty ones and their time per value of ``by``, each id once."""
    good = (F.col("duration_ms") >= 0) & ~F.isnan("duration_ms")
    once = audit.groupBy("id").agg(F.min(by).alias(by), F.min("result_count").alias("n"), F.min(F.when(good, F.col("duration_ms"))).alias("ms"))
    return once.groupBy(by).agg(F.count("*").alias("searches"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("ms").alias("total_ms"))


def failure_alerts(checks: DataFrame, bucket: str = "bucket", name: str = "name") -> DataFrame:
    """One alert per bucket with the names of all measures whose ``status`` is error (as many as there are measures)."""
    bad = checks.where("status = 'error'").select(bucket, name).distinct()
    return bad.groupBy(bucket).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("failed"), F.count("*").alias("n_failed"))


def digest_alerts(values: DataFrame, key: str) -> DataFrame:
    """Per bucket and measure a line of the digest: value and its change, signed, or ``first``."""
    delta = F.col("value") - F.lag("value").over(Window.partitionBy(key).orderBy("bucket"))
    cents = F.round(delta * 100).cast("bigint")
    sign = F.when(cents < 0, "-").otherwise("+")
    change = F.concat(sign, F.floor(F.abs(cents) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return values.select(key, "bucket", F.coalesce(F.when(delta.isNotNull(), change), F.lit("first")).alias("change"))


def question_rows(sessions: DataFrame, col: str = "questions") -> DataFrame:
    """Evaluation queries: one row per non-blank question of a session, with its place."""
    rows = sessions.select("id", "project", "date", F.posexplode(col).alias("place", "query"))
    return rows.where(~is_blank("query"))
