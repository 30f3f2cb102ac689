"""Keeping an index current: change detection, upserts, replaced chunks, enrichment queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENRICHED = ("summary", "tags", "entities", "learnings", "questions", "enriched_at", "enrichment_version")
ENRICHMENT_VERSION = 3


def changed(found: DataFrame, indexed: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """Rows of ``found`` that are new or whose ``hash`` differs."""
    if force:
        return found
    old = indexed.select(F.col(key).alias("_key"), F.col("hash").alias("_hash"))
    return found.join(old, (found[key] == F.col("_key")) & found["hash"].eqNullSafe(F.col("_hash")), "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """The next snapshot of the sessions.

    Only in one: taken as it is. In both: fresh values; with an equal hash the stored title (if any) and enrichment stay, with another one
    the enrichment is cleared.
    """
    cols = stored.columns
    s, f = stored.alias("s"), fresh.alias("f")
    both = s.join(f, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer")
    same = F.col("s.hash") == F.col("f.hash")
    is_new, is_old = F.col(f"s.{key}").isNull(), F.col(f"f.{key}").isNull()

    def pick(c: str):
        if c not in fresh.columns or c in ENRICHED:
            own = F.col(f"f.{c}") if c in fresh.columns else F.lit(None).cast(stored.schema[c].dataType)
            return F.when(is_old | same, F.col(f"s.{c}")).otherwise(F.when(is_new, own)).alias(c)
        if c == "title":
            return F.when(is_old, F.col("s.title")).when(same, F.coalesce("s.title", "f.title")).otherwise(F.col("f.title")).alias(c)
        return F.when(is_old, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c)

    return both.select(*[pick(c) for c in cols])


def replace_rows(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of touched keys are replaced as a whole (chunks, vectors or postings of a session)."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def last_wins(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key of an append-only log."""
    cols = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(*key, "x.*")


def pending_enrichment(sessions: DataFrame, older_than_ms: int | None = None, force: bool = False) -> DataFrame:
    """Sessions never enriched or by an older version, quiet since ``older_than_ms``."""
    need = F.col("enriched_at").isNull() | F.coalesce(F.col("enrichment_version") < ENRICHMENT_VERSION, F.lit(True))
    rows = sessions if force else sessions.where(need)
    return rows if older_than_ms is None else rows.where(F.coalesce("last_message_at", "indexed_at") < older_than_ms)


def without_summary_chunk(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Enriched sessions with a summary that lack their summary chunk."""
    have = chunks.where("seq = -1").select(F.col("session_id").alias("id"))
    return sessions.where("enriched_at IS NOT NULL AND summary IS NOT NULL AND summary != ''").join(have, "id", "left_anti")


def summary_chunks(sessions: DataFrame) -> DataFrame:
    """The synthetic chunk of each summary; empty parts are skipped."""

    def listed(label: str, col: str, sep: str):
        text = F.array_join(F.coalesce(col, F.array().cast("array<string>")), sep)
        return F.when(F.size(F.coalesce(col, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{label}: "), text))

    parts = [F.when(F.col("summary") != "", F.col("summary")), listed("Tags", "tags", ", "), listed("Entities", "entities", ", "), listed("Learnings", "learnings", " "), listed("Questions", "questions", " ")]
    return sessions.select(F.concat("id", F.lit("_summary")).alias("id"), F.col("id").alias("session_id"), F.lit(-1).alias("seq"), F.lit(-1).alias("pos"), F.concat_ws("\n", *parts).alias("text"))


def digest(docs: DataFrame, id_col: str, text_col: str, max_chars: int = 6000) -> DataFrame:
    """Lines of a text without tool lines, up to ``max_chars``; ``kept`` lines and whether it was cut.

    A text's lines stay in its own row (higher-order functions), so there is no shuffle.
    """
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~x.startswith("[Tool]"))
    state = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("kept"), F.lit(False).alias("cut"))

    def step(acc, x):
        full = acc["cut"] | (acc["chars"] + F.length(x) > max_chars)
        return F.struct(F.when(full, acc["chars"]).otherwise(acc["chars"] + F.length(x) + 1).alias("chars"), F.when(full, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"), full.alias("cut"))

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), lines.alias("l"))
    rows = rows.withColumn("s", F.aggregate("l", state, step))
    text = F.array_join(F.concat(F.slice("l", F.lit(1), F.col("s.kept")), F.when(F.col("s.cut"), F.array(F.lit("... (truncated)"))).otherwise(F.array().cast("array<string>"))), "\n")
    return rows.select("id", F.col("s.kept").alias("kept"), F.col("s.cut").alias("cut"), text.alias("digest"))


def parse_reply(replies: DataFrame, text_col: str) -> DataFrame:
    """Typed fields from a model's reply: think blocks dropped, the widest brace span read as JSON; without braces the start is the summary."""
    clean = F.trim(F.regexp_replace(text_col, r"<think>[\s\S]*?</think>", ""))
    span = F.regexp_extract(clean, r"(\{[\s\S]*\})", 1)
    v = F.try_parse_json(F.when(span != "", span))

    def text(name: str):
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))

    def texts(name: str):
        return F.coalesce(F.filter(F.try_variant_get(v, f"$.{name}", "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))

    summary = F.when(span == "", F.substring(clean, 1, 500)).otherwise(text("summary"))
    return replies.select("*", text("title").alias("title"), summary.alias("summary"), *[texts(n).alias(n) for n in ("tags", "entities", "learnings", "questions")])


def latest_by_priority(live: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Union of two scans; of a key in both the live row wins."""
    return live.unionByName(archive.join(live.select(key), key, "left_anti"))


def capped_sample(rows: DataFrame, group: str, key: str, n: int = 100, least: int = 3, seed: int = 1) -> DataFrame:
    """A sampling operator: ``n`` rows in an order fixed by md5 of key and seed, of each group at most max(``least``, n div groups)."""
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    groups = rows.select(group).distinct().count()
    w = Window.partitionBy(group).orderBy(order, key)
    capped = rows.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= max(least, n // max(1, groups))).drop("_no")
    return capped.orderBy(order, key).limit(n)


def finished_without_chunks(pending: DataFrame, chunks: DataFrame, at_ms: int, version: int = ENRICHMENT_VERSION) -> DataFrame:
    """Queued sessions that hold no text to enrich, marked as done so that they leave the queue."""
    none = pending.join(chunks.where("seq >= 0").select(F.col("session_id").alias("id")), "id", "left_anti")
    return none.withColumn("enriched_at", F.lit(at_ms).cast("bigint")).withColumn("enrichment_version", F.lit(version).cast(pending.schema["enrichment_version"].dataType))


def archived(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (``project, name, raw``) that the archive (``project, name``) doesn't hold yet; of equal ones one."""
    return files.dropDuplicates(["project", "name"]).join(stored.select("project", "name").distinct(), ["project", "name"], "left_anti")


def archive(files: DataFrame, path: str) -> None:
    """Copy files into an archive of Parquet folders by project; what is there stays as it is."""
    spark = files.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    schema = files.select("project", "name", "raw").schema
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    archived(files.select("project", "name", "raw"), stored).write.mode("append").partitionBy("project").parquet(path)
