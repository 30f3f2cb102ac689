"""Retrieval quality: found@k, NDCG@k, percentiles, why a query missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import staged


def quality(retrieved: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, found, ndcg``; ``retrieved`` has ``query_id, item, rk``, ``relevant`` ``query_id, item``. Binary gain."""
    hits = relevant.join(retrieved, ["query_id", "item"], "left")
    gain = F.when(F.col("rk") <= k, 1 / F.log2(F.col("rk") + 1)).otherwise(0.0)
    per = hits.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.count("*").alias("n_rel"), F.min("rk").alias("best"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.select("query_id", (F.coalesce("best", F.lit(k + 1)) <= k).cast("int").alias("found"), (F.col("dcg") / ideal).alias("ndcg"))


def summary(per_query: DataFrame) -> DataFrame:
    """Mean found@k and NDCG@k over all queries, four decimals."""
    return per_query.agg(F.count("*").alias("queries"), F.round(F.avg("found"), 4).alias("found_at_k"), F.round(F.avg("ndcg"), 4).alias("ndcg_at_k"))


def latency_percentiles(rows: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95), group: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, of any number of values: ``group`` (if given) and a column per percentile.

    Values are counted first. Equal values then lie in ranges of (group, value); each range adds the counts of those before it, so every distinct value knows its
    ranks and only the two around each percentile are kept. No group is sorted or held by one task. Null and NaN values are left out.
    """
    spark, name = rows.sparkSession, group or "_all"
    key = F.col(group) if group else F.lit(0)
    counts = rows.select(key.alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("g", "v").agg(F.count("*").alias("n"))
    ranged = staged(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "counts")
    parts = ranged.groupBy("g", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy("g")))
    within = Window.partitionBy("g", "part").orderBy("v")
    placed = ranged.withColumn("upto", F.sum("n").over(within)).join(parts.select(F.col("g").alias("_g"), F.col("part").alias("_p"), "before", "total"), F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
    last = F.col("before") + F.col("upto")  # ranks of this value, from 1
    first = last - F.col("n") + 1
    aggs = []
    for p in ps:
        at = (F.col("total") - 1) * p + 1
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((first <= rank) & (rank <= last), F.col("v"))).alias(f"{side}{round(p * 100)}"))
    found = placed.groupBy("g").agg(*aggs, F.first("total").alias("total"))
    out = []
    for p in ps:
        at, no = (F.col("total") - 1) * p, round(p * 100)
        out.append((F.col(f"lo{no}") + (F.col(f"hi{no}") - F.col(f"lo{no}")) * (at - F.floor(at))).alias(f"p{no}"))
    found = found.select(F.col("g").alias(name), *out)
    if group:
        return found
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(f"p{round(p * 100)}") for p in ps])
    return found.drop(name) if not found.isEmpty() else none


def diagnosis(retrieved: DataFrame, relevant: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """Why each query's item wasn't in the first k: OK, NOT_RETRIEVED, COMPETING_SESSIONS (the winner has twice its chunks), RANKED_LOW."""
    top = retrieved.where("rk = 1").select("query_id", F.col("item").alias("winner"))
    n = sizes.select("item", "n_chunks")
    rows = (
        relevant.join(retrieved, ["query_id", "item"], "left").join(top, "query_id", "left").join(n, "item", "left")
        .join(n.select(F.col("item").alias("winner"), F.col("n_chunks").alias("winner_chunks")), "winner", "left")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("rk").asc_nulls_last(), "item")
    rows = rows.withColumn("_no", F.row_number().over(best)).where("_no = 1")
    why = (
        F.when(F.col("rk") <= k, "OK")
        .when(F.col("rk").isNull(), "NOT_RETRIEVED")
        .when(F.col("winner_chunks") >= 2 * F.coalesce("n_chunks", F.lit(0)), "COMPETING_SESSIONS")
        .otherwise("RANKED_LOW")
    )
    return rows.select("query_id", why.alias("diagnosis"))


def indexed_only(relevant: DataFrame, indexed: DataFrame) -> DataFrame:
    """The judged searches (``query_id, item``) whose item has an entry in the index (``item``)."""
    return relevant.join(indexed.select("item").distinct(), "item", "left_semi").select("query_id", "item")


def store_result(per_query: DataFrame, path: str, run: str, settings: dict[str, str]) -> None:
    """The measures of a run with its settings, one JSON line each, behind what is stored."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(settings.items()) for x in kv]) if settings else F.create_map().cast("map<string,string>")
    summary(per_query).select(F.lit(run).alias("run"), pairs.alias("settings"), "*").write.mode("append").json(path)
