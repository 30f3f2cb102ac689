"""Activity logs as runs: open and close marks become groups, empty neighbours collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import staged

# Event types of the two kinds of run.
START = {"index": "index_started", "enrich": "enrich_started"}
DONE = {"index": "index_complete", "enrich": "enrich_complete"}
ITEM = {"index": "session_indexed", "enrich": "session_enriched"}


def _offsets(rows: DataFrame, log: str, blk: str, counted: Column) -> DataFrame:
    """``rows`` with ``offset``, the sum of ``counted`` over earlier blocks of the log. Only a row per block is put in order."""
    blocks = rows.groupBy(log, blk).agg(F.sum(counted.cast("bigint")).alias("n"))
    before = Window.partitionBy(log).orderBy(F.col(blk).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(log).alias("_l"), F.col(blk).alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(blocks, F.col(log).eqNullSafe(F.col("_l")) & F.col(blk).eqNullSafe(F.col("_b"))).drop("_l", "_b")


def run_groups(events: DataFrame, log: str = "log", ts: str = "ts", kind: str = "type", order: str = "event_id") -> DataFrame:
    """Runs per log: ``log, kind, start_ts, start_no, closed, complete, running, n_items``; ``closed`` is the place of what ended it, null if nothing did.

    A start opens a run of its kind and ends an open one (which stays marked running); completion closes; a daemon start closes
    both kinds; items belong to the open run, or to none. Windows run over a log's events of one day; what a day hands on to the next is one number, so a
    log may hold any share of all events. Events without an instant are left out; a null log is a log of its own; an empty table gives no rows.
    """
    base = events.select(F.col(log).alias("log"), F.col(ts).alias("ts"), F.col(kind).alias("type"), F.col(order).alias("no")).where("ts IS NOT NULL").withColumn("blk", F.to_date("ts"))
    parts = []
    for name in START:
        mine = base.where(F.col("type").isin(START[name], DONE[name], ITEM[name], "daemon_started"))
        day = Window.partitionBy("log", "blk").orderBy("ts", "no")
        cut = F.col("type").isin(START[name], "daemon_started")
        numbered = _offsets(mine.withColumn("local", F.sum(cut.cast("bigint")).over(day)), "log", "blk", cut).withColumn("run", F.col("offset") + F.col("local"))
        done = F.sum((F.col("type") == DONE[name]).cast("int")).over(Window.partitionBy("log", "blk", "run").orderBy("ts", "no").rowsBetween(Window.unboundedPreceding, -1))
        days = numbered.withColumn("done", F.coalesce(done, F.lit(0))).groupBy("log", "run", "blk").agg(
            F.min(F.when(cut, F.struct("ts", "no", "type"))).alias("begin"),
            F.min(F.when(F.col("type") == DONE[name], F.struct("ts", "no"))).alias("d"),
            F.count_if((F.col("type") == ITEM[name]) & (F.col("done") == 0)).alias("n"),
        )
        # Of a run over several days, those behind its completion count for nothing.
        earlier = Window.partitionBy("log", "run").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        runs = days.withColumn("over", F.coalesce(F.max(F.col("d").isNotNull()).over(earlier), F.lit(False))).groupBy("log", "run").agg(
            F.min("begin").alias("begin"), F.min("d").alias("d"), F.sum(F.when(F.col("over"), 0).otherwise(F.col("n"))).alias("n_items")
        )
        nxt = runs.select(F.col("log").alias("_l"), (F.col("run") - 1).alias("_r"), F.col("begin.type").alias("closer"), F.struct("begin.ts", "begin.no").alias("closer_at"))
        joined = runs.join(nxt, F.col("log").eqNullSafe(F.col("_l")) & (F.col("run") == F.col("_r")), "left").where(F.col("begin.type") == START[name])
        parts.append(
            joined.select(
                "log", F.lit(name).alias("kind"), F.col("begin.ts").alias("start_ts"), F.col("begin.no").alias("start_no"), F.coalesce("d", "closer_at").alias("closed"), F.col("d").isNotNull().alias("complete"),
                (F.col("d").isNull() & (F.coalesce("closer", F.lit("")) != "daemon_started")).alias("running"), "n_items",
            )
        )
    return parts[0].unionByName(parts[1])


def close_stale(runs: DataFrame, now: Column, enriching: bool = False, indexing: bool = False) -> DataFrame:
    """Runs that only look as if they ran: an enrich run that began over 30 seconds ago while nothing is ``enriching``, any other over ten minutes unless ``indexing``."""
    age = F.unix_millis(now) - F.unix_millis("start_ts")
    stale = F.when(F.col("kind") == "enrich", F.lit(not enriching) & (age > 30_000)).otherwise(F.lit(not indexing) & (age > 600_000))
    return runs.withColumn("running", F.col("running") & ~stale)


def run_label(kind: Column, running: Column, n_runs: Column, n_items: Column) -> tuple[Column, Column]:
    """(label, detail) of a run or of several collapsed ones."""
    index = kind == "index"
    label = F.when(index, F.when(running, "Indexing…").otherwise("Index scan")).otherwise(F.when(running, "Enriching…").otherwise("Enrich run"))
    n = n_items.cast("string")
    live = F.when(index, F.when(n_items > 0, F.concat(n, F.lit(" indexed")))).otherwise(F.concat(n, F.lit(" / ?")))
    plain = F.concat(n, F.when(index, " new").otherwise(""), F.lit(" session"), F.when(n_items == 1, "").otherwise("s"), F.when(index, "").otherwise(" enriched"))
    many = F.concat(n_runs.cast("string"), F.when(index, "× no new sessions").otherwise("× nothing to enrich"))
    return label, F.when(n_runs > 1, many).when(running, live).otherwise(plain)


def collapse_empty(groups: DataFrame, empty: Column, order: list[Column], log: str = "log", block: Column | None = None) -> DataFrame:
    """Neighbouring rows that are ``empty`` become one with their count; ``first_no`` numbers a log's rows in ``order``.

    ``block`` must rise with ``order`` (null last); windows run within a block, and a block hands on its number of rows, of islands and whether its last row
    was empty. Without it a log is one block. Columns: the log, ``first_no, n_runs, n_items, collapsed, empty, first`` (the first row).
    """
    cols = groups.columns
    marked = groups.withColumn("_row", F.struct(*cols)).withColumn("empty", F.coalesce(empty, F.lit(False))).withColumn("blk", block if block is not None else F.lit(0))
    w = Window.partitionBy(log, "blk").orderBy(*order)
    marked = staged(marked.withColumn("local", F.row_number().over(w)).withColumn("prev", F.lag("empty").over(w)), "places")  # read by the rows and by what blocks hand on
    lasts = marked.groupBy(log, "blk").agg(F.max_by("empty", "local").alias("last"))
    handed = F.lag("last").over(Window.partitionBy(log).orderBy(F.col("blk").asc_nulls_last()))
    lasts = lasts.select(F.col(log).alias("_l"), F.col("blk").alias("_b"), handed.alias("handed"))
    marked = marked.join(lasts, F.col(log).eqNullSafe(F.col("_l")) & F.col("blk").eqNullSafe(F.col("_b"))).drop("_l", "_b")
    # A row begins an island unless it and the one before are empty.
    fresh = ~(F.col("empty") & F.coalesce("prev", F.when(F.col("local") == 1, F.col("handed")), F.lit(False)))
    marked = _offsets(marked.withColumn("fresh", fresh), log, "blk", F.lit(1)).withColumn("no", F.col("offset") + F.col("local")).drop("offset")
    islands = _offsets(marked.withColumn("inner", F.sum(F.col("fresh").cast("bigint")).over(w)), log, "blk", F.col("fresh"))
    return (
        islands.withColumn("island", F.col("offset") + F.col("inner"))
        .groupBy(log, "island")
        .agg(F.count("*").alias("n_runs"), F.min("no").alias("first_no"), F.sum("n_items").alias("n_items"), F.bool_or("empty").alias("empty"), F.min_by("_row", "no").alias("first"))
        .select(log, "first_no", "n_runs", "n_items", (F.col("empty") & (F.col("n_runs") > 1)).alias("collapsed"), "empty", "first")
    )


def activity_feed(runs: DataFrame) -> DataFrame:
    """Runs in the order they were closed, empty neighbours collapsed, index runs first and then enrich runs in what is left: ``log, no, kind, n_runs, n_items, running, label, detail``."""

    def idle(kind: str) -> Column:
        return (F.col("kind") == kind) & ~F.col("running") & (F.col("n_items") == 0)

    order = [F.col("closed").asc_nulls_last(), F.col("kind").desc(), F.col("start_no")]
    once = collapse_empty(runs.select("log", "kind", "running", "n_items", "closed", "start_no"), idle("index"), order, block=F.to_date("closed.ts"))
    once = once.select("log", "first_no", F.col("n_runs").alias("merged"), "first.kind", "first.running", "n_items")
    twice = collapse_empty(once, idle("enrich") & (F.col("merged") == 1), [F.col("first_no")], block=F.floor(F.col("first_no") / 4096))
    rows = twice.select("log", F.col("first.first_no").alias("no"), "first.kind", (F.col("n_runs") * F.col("first.merged")).alias("n_runs"), "n_items", "first.running")
    label, detail = run_label(F.col("kind"), F.col("running"), F.col("n_runs"), F.col("n_items"))
    return rows.withColumn("label", label).withColumn("detail", detail)
