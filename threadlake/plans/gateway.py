"""A read-only SQL gateway: one SELECT, no semicolon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlake.session import table


class NotAllowed(ValueError):
    """The text isn't a single SELECT."""


def run_select(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of one SELECT over ``tables``; text that doesn't begin with SELECT or holds a semicolon is refused."""
    text = sql.strip()
    if not text[:6].lower() == "select" or ";" in text:
        raise NotAllowed("only a single SELECT without semicolons is allowed")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def star_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}
