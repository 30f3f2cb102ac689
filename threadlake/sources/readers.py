"""Readers of logs and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.maintenance import changed


def transcript_files(spark: SparkSession, root: str) -> DataFrame:
    """``*.jsonl`` at depth one and two: ``path, session_id, hash, modified, raw``; deeper files are left out.

    A session's id is the first eight characters of its file's name without dashes. Files are read whole, as their hash is that of the file.
    """
    return _files(spark, [f"{root}/*.jsonl", f"{root}/*/*.jsonl"])


def transcript_file(spark: SparkSession, path: str) -> DataFrame:
    """The same of one file, whose name must end in ``.jsonl``."""
    if not path.endswith(".jsonl"):
        raise ValueError("a transcript's name ends in .jsonl")
    return _files(spark, [path])


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.substring(F.regexp_replace(name, "-", ""), 1, 8).alias("session_id"),
        F.sha2("value", 256).alias("hash"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"),
    )


def touched_files(files: DataFrame, sessions: DataFrame, force: bool = False) -> DataFrame:
    """Files never indexed, or modified since; then those whose hash differs."""
    if force:
        return files
    seen = sessions.select("path", F.timestamp_millis("indexed_at").alias("_at"))
    newer = files.join(seen, "path", "left").where(F.col("_at").isNull() | (F.col("modified") >= F.col("_at"))).drop("_at")
    return changed(newer.withColumnRenamed("session_id", "id"), sessions).withColumnRenamed("id", "session_id")


def transcript_lines(files: DataFrame) -> DataFrame:
    """``session_id, line_no, raw`` of the non-blank lines, in file order from 1."""
    lines = files.select("session_id", F.posexplode(F.split("raw", "\n")).alias("i", "raw"))
    return lines.where("trim(raw) != ''").select("session_id", (F.col("i") + 1).alias("line_no"), "raw")


def activity_log(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The last ``n`` readable events of a JSON-lines log, newest first."""
    rows = spark.read.schema("ts bigint, type string, data string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("type IS NOT NULL").drop("_bad").orderBy(F.col("ts").desc()).limit(n)


def log_tail(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The last ``n`` non-empty lines of a text log, oldest first: ``line``. Rotated files (a folder or pattern) follow one another by name."""
    at = ("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path).where("value != ''").select(F.col(at[0]).alias("f"), F.col(at[1]).alias("b"), F.monotonically_increasing_id().alias("no"), "value")
    last = lines.orderBy(F.col("f").desc(), F.col("b").desc(), F.col("no").desc()).limit(n)
    return last.orderBy("f", "b", "no").select(F.col("value").alias("line"))


def append_activity(events: DataFrame, path: str) -> None:
    """Append events to a log as JSON lines."""
    events.write.mode("append").json(path)


def markdown_vault(spark: SparkSession, root: str, min_body: int = 800) -> DataFrame:
    """Notes below ``root`` whose name ends in eight hex digits and whose body is long enough: ``short_id, front, body``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    front = F.regexp_extract("value", r"\A---\n([\s\S]*?)\n---\n", 1)
    body = F.regexp_replace("value", r"\A---\n[\s\S]*?\n---\n", "")
    sid = F.regexp_extract("_metadata.file_path", r"([0-9a-f]{8})\.md$", 1)
    return files.select(sid.alias("short_id"), front.alias("front"), body.alias("body")).where((F.col("short_id") != "") & (F.length("body") >= min_body))


def metric_configs(spark: SparkSession, root: str) -> DataFrame:
    """JSON configs in order of their path."""
    return spark.read.option("multiLine", "true").json(f"{root}/*.json").withColumn("_path", F.col("_metadata.file_path")).orderBy("_path")
