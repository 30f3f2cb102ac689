"""Snapshots of measures: last value per bucket, deltas, values out of JSON, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_bucket(rows: DataFrame, key: str, ts: str, value: str, unit: str) -> DataFrame:
    """The newest value of each hour, day, week or month."""
    return rows.groupBy(key, F.date_trunc(unit, ts).alias("bucket")).agg(F.max_by(value, F.struct(ts, value)).alias("value"))


def deltas(buckets: DataFrame, key: str) -> DataFrame:
    """Change against the bucket before; null for the first."""
    w = Window.partitionBy(key).orderBy("bucket")
    return buckets.withColumn("delta", F.col("value") - F.lag("value").over(w))


def changes(current: DataFrame, min_delta: float = 1.0, direction: str = "any") -> DataFrame:
    """Rows whose delta is large enough and goes the wanted way."""
    way = {"any": F.lit(True), "up": F.col("delta") > 0, "down": F.col("delta") < 0}[direction]
    return current.where((F.abs("delta") >= min_delta) & way)


_FILTER = re.compile(r"(\w+)\[(\w+)=([^\]]+)\]")


def _where(field: str, want: str):
    return lambda x: F.try_variant_get(x, f"$['{field}']", "string") == want


def json_path(body: Column, path: str, default: str | None = None) -> Column:
    """A value by dotted path as a JVM expression: names, list indexes (``a.0.b`` or ``a[0].b``) and ``name[field=value]``, the first element that matches.

    The path is compiled once on the driver. A step that finds nothing gives null, or ``default``; so do a JSON null and text that can't be read. JSON within a
    string is a string. What is no scalar comes out as JSON.
    """
    out = F.try_parse_json(body)
    for part in re.sub(r"\[(\d+)\]", r".\1", path).split("."):
        chosen = _FILTER.fullmatch(part)
        if chosen:
            name, field, want = chosen.groups()
            out = F.get(F.filter(F.try_variant_get(out, f"$['{name}']", "array<variant>"), _where(field, want)), F.lit(0))
        elif part.isdigit():  # or a name of digits where there is no list
            out = F.coalesce(F.try_variant_get(out, f"$[{part}]", "variant"), F.try_variant_get(out, f"$['{part}']", "variant"))
        else:
            out = F.try_variant_get(out, f"$['{part}']", "variant")
    text = F.coalesce(F.try_variant_get(out, "$", "string"), F.when(~F.is_variant_null(out), F.to_json(out)))
    return F.coalesce(text, F.lit(default)) if default is not None else text


def regex_value(body: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, the point also standing for line breaks; null where there is no match."""
    return F.when(body.rlike(f"(?s){pattern}"), F.regexp_extract(body, f"(?s){pattern}", group))


def cast_value(raw: Column, kind: str) -> Column:
    """``string``, ``int``, ``float`` or ``money_cents`` (hundredths, two decimals); null where it can't be read."""
    if kind == "money_cents":
        return F.round(raw.try_cast("double") / 100, 2)
    return raw.try_cast({"string": "string", "int": "bigint", "float": "double"}[kind])


def checked(value: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``ok`` or ``error``; the value itself is kept either way."""
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (value < lo)
    if hi is not None:
        bad = bad | (value > hi)
    return F.when(value.isNull() | bad, "error").otherwise("ok")


# ---- stored snapshots


def append_snapshot(values: DataFrame, path: str, project: str, at_ms: int) -> None:
    """One row per measure of a fetch (``metric, value``) behind what is stored."""
    values.select(F.lit(project).alias("project"), F.lit(at_ms).cast("bigint").alias("fetched_at"), "metric", "value").write.mode("append").parquet(path)


def latest_snapshot(history: DataFrame) -> DataFrame:
    """Every measure as of its project's newest fetch."""
    newest = history.groupBy("project").agg(F.max("fetched_at").alias("fetched_at"))
    return history.join(newest, ["project", "fetched_at"], "left_semi")


def snapshot_history(history: DataFrame, project: str) -> DataFrame:
    """A project's fetches, oldest first."""
    return history.where(F.col("project") == project).orderBy("fetched_at", "metric")
