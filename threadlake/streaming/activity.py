"""Streaming forms of the activity operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.operators.maintenance import last_wins
from threadlake.session import new_path


def event_stream(spark: SparkSession, path: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The Parquet table at ``path``, a file or a folder of files, as a stream with a watermark; zone-less timestamps are read as UTC instants."""
    schema = spark.read.parquet(path).schema
    one = f"{path[:-1]}[{path[-1]}]"  # as a pattern that only the path itself matches: a stream takes no single file by its name
    return spark.readStream.schema(schema).parquet(one).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, width: str, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts and sums per window; with ``slide`` the windows overlap."""
    return events.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def last_values(events: DataFrame, width: str, ts: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The newest value per window and key."""
    return events.groupBy(F.window(ts, width), *keys).agg(F.max_by("value", F.struct(ts, "value")).alias("value"))


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Session windows; here a gap of exactly ``gap`` parts two runs."""
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def run_available(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream over what is there and give the result table.

    With ``keys`` each batch writes only the rows it changed (update mode) below its number, and the newest row of a key stands: an upsert that is
    merged when it is read, so windows behind the watermark leave the state. Without keys each batch writes all rows anew (complete mode), which session
    windows need here: in append mode those still open at the end of the input would be missing. Nothing passes through the driver, a
    repeated batch replaces its own folder, and batches without rows write nothing.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    done: list[int] = []

    def take(batch: DataFrame, no: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/no={no}")
            done.append(no)

    writer = df.writeStream.outputMode("update" if keys else "complete").foreachBatch(take).queryName(name)
    writer.option("checkpointLocation", new_path(spark, f"ckpt-{name}")).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    if not keys:
        return spark.read.schema(df.schema).parquet(f"{path}/no={max(done)}")
    log = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("no", T.LongType())])).parquet(path)
    return last_wins(log, list(keys), "no").select(*df.columns)


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand micro-batches to an incremental job (upsert, postings, pair table): one query at a time, restartable.

    Batches without rows are skipped, so nothing is written or reported where nothing is new.
    """

    def some(batch: DataFrame, no: int) -> None:
        if not batch.isEmpty():
            take(batch, no)

    writer = stream.writeStream.foreachBatch(some).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
