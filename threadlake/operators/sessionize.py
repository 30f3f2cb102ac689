"""Grouping activity into runs separated by idle gaps.

Rows are range-partitioned by (key, time) and sorted inside each partition, so a key that holds a third of
all rows is spread over many tasks. Each task then makes one linear scan with constant memory (one open
run is carried from batch to batch). Only the first and the last run of a partition can continue in a
neighbouring one; those few (two per partition, whatever the data) are joined up in a second, tiny step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.functions.instants import instant_ms
from threadlake.session import staged


def _scan(gap_ms: int, out_schema: pa.Schema):
    """The per-partition scan: sorted (key, ts) batches in, runs out."""

    def batch_of(rows: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(rows, schema=out_schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple | None = None  # key, start, end, n of the open run
        first = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            ts = batch.column(1).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = (code[1:] != code[:-1]) | (ts[1:] - ts[:-1] > gap_ms)
            joins = carry is not None and carry[0] == coded.dictionary[code[0]].as_py() and ts[0] - carry[2] <= gap_ms
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n) - 1
            key = coded.dictionary.take(pa.array(code[starts]))
            start, end, count = ts[starts], ts[ends], ends - starts + 1
            if joins:
                start, count = start.copy(), count.copy()
                start[0], count[0] = carry[1], count[0] + carry[3]
            elif carry is not None:
                yield batch_of({"key": [carry[0]], "start_ms": [carry[1]], "end_ms": [carry[2]], "n_events": [carry[3]], "edge": [first]})
                first = False
            m = len(starts) - 1
            if m:
                edge = np.zeros(m, bool)
                edge[0], first = first, False
                yield batch_of({"key": key[:m], "start_ms": start[:m], "end_ms": end[:m], "n_events": count[:m], "edge": edge})
            carry = (key[m].as_py(), int(start[m]), int(end[m]), int(count[m]))
        if carry is not None:
            yield batch_of({"key": [carry[0]], "start_ms": [carry[1]], "end_ms": [carry[2]], "n_events": [carry[3]], "edge": [True]})

    return scan


def sessionize(events: DataFrame, key: str, ts_ms: str, gap_ms: int = 900_000) -> DataFrame:
    """Runs of activity per key: ``key, start_ms, end_ms, duration_ms, n_events``.

    A new run starts where *more* than ``gap_ms`` milliseconds have passed since the event before.

    Defined results: rows without an instant are left out; a null key is a key of its own; equal
    instants and repeated rows count each; a single event is a run of duration 0; an empty table gives no
    rows. Other columns are ignored, so their names cannot clash.
    """
    if gap_ms < 0:
        raise ValueError("gap_ms must not be negative")
    kind = events.schema[key].dataType
    rows = events.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ts_ms}`").cast("bigint").alias("ts")).where(F.col("ts").isNotNull())
    # With range partitioning equal (key, ts) stay together and partitions follow each other in time.
    ordered = rows.repartitionByRange("key", "ts").sortWithinPartitions("key", "ts")
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("start_ms", T.LongType()),
            T.StructField("end_ms", T.LongType()),
            T.StructField("n_events", T.LongType()),
            T.StructField("edge", T.BooleanType()),
        ]
    )
    # Read twice below, so it is written once: the scan doesn't run again and its lineage ends here.
    runs = staged(ordered.mapInArrow(_scan(gap_ms, to_arrow_schema(schema)), schema), "runs")
    # At most two edge runs per partition: key + gap decide which belong together.
    w = Window.partitionBy("key").orderBy("start_ms", "end_ms")
    edges = (
        runs.where("edge")
        .withColumn("cut", (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms).cast("int"))
        .withColumn("no", F.sum(F.coalesce("cut", F.lit(1))).over(w))
        .groupBy("key", "no")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events"))
    )
    cols = ["key", "start_ms", "end_ms", "n_events"]
    return (
        runs.where(~F.col("edge"))
        .select(*cols)
        .unionByName(edges.select(*cols))
        .select(F.col("key").alias(key), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")
    )


def line_instants(messages: DataFrame) -> DataFrame:
    """Lines counted once per (session_id, line_no), each with its readable instant: ``session_id, line_no, ts_ms``.

    A line received again keeps one instant (the earliest readable); lines without any are left out.
    """
    return (
        messages.select("session_id", "line_no", instant_ms("timestamp").alias("ts_ms"))
        .where(F.col("ts_ms").isNotNull())
        .groupBy("session_id", "line_no")
        .agg(F.min("ts_ms").alias("ts_ms"))
    )
