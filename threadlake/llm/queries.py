"""Registered queries of the text and chat operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions.instants import epoch_ms
from threadlake.llm import conversations, cooccurrence, mixing, packing, pii, quantiles, splitting
from threadlake.llm.sql import SQL
from threadlake.session import staged, table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_defects(table(spark, sf_dir, "messages"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations turn by turn."""
    return conversations.rebuild_conversations(table(spark, sf_dir, "messages"))


#: Secret of the pseudonyms in the registered query; an application passes its own.
DEMO_KEY = b"threadlake demonstration key"


def _ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinary words of both tables' texts."""
    texts = table(spark, sf_dir, "messages").select(F.col("content_text").alias("text")).unionAll(table(spark, sf_dir, "chunks").select("text"))
    return staged(pii.ordinary_counts(texts, "text"), "ordinary")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "known_names")
    ordinary = _ordinary(spark, sf_dir)
    messages = pii.find_pii(table(spark, sf_dir, "messages"), "line_id", "content_text", names, ordinary=ordinary)
    chunks = pii.find_pii(table(spark, sf_dir, "chunks"), "id", "text", names, ordinary=ordinary).distinct()  # some rows repeat exactly
    return messages.withColumn("source_table", F.lit("messages")).unionByName(chunks.withColumn("source_table", F.lit("chunks"))).select("source_table", "row_key", "kind", "value").where("kind != 'birth_date'")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts with placeholders."""
    names = table(spark, sf_dir, "known_names")
    ordinary = _ordinary(spark, sf_dir)
    messages = pii.redact(table(spark, sf_dir, "messages"), "line_id", "content_text", names, DEMO_KEY, ordinary=ordinary)
    chunks = pii.redact(table(spark, sf_dir, "chunks"), "id", "text", names, DEMO_KEY, ordinary=ordinary)
    return messages.withColumn("source_table", F.lit("messages")).unionByName(chunks.withColumn("source_table", F.lit("chunks")))


def _session_batches(sessions: DataFrame) -> list[DataFrame]:
    """The sessions as an archive receives them, in three batches of ``id, tags, entities`` whose last states are the table's.

    First those of the earlier two thirds (by ``indexed_at``), of which the later ones still lack their last item and hold a draft mark, and a draft copy of each
    early one; then the newest third and the changed ones; then the drafts are withdrawn.
    """
    lo, hi = (sessions.approxQuantile("indexed_at", [1 / 3, 2 / 3], 0.05) or [0, 0])[:2]
    rows = sessions.select(F.col("id").cast("string").alias("id"), "tags", "entities", F.when(F.coalesce("indexed_at", F.lit(0)) <= lo, 0).when(F.col("indexed_at") <= hi, 1).otherwise(2).alias("age"))
    early, later, newest = (rows.where(F.col("age") == x).drop("age") for x in range(3))

    def draft(col: str):
        return F.when(F.size(col) > 0, F.array_append(F.slice(col, F.lit(1), F.size(col) - 1), F.lit("draft"))).alias(col)

    drafts = early.withColumn("id", F.concat("id", F.lit(" (draft)")))
    none = F.lit(None).cast("array<string>")
    return [early.unionByName(drafts).unionByName(later.select("id", draft("tags"), draft("entities"))), newest.unionByName(later), drafts.select("id", none.alias("tags"), none.alias("entities"))]


def _pair_table(spark: SparkSession, sf_dir: str) -> cooccurrence.PairTable:
    """The pair table of all sessions after three batches: new baskets, changed ones, removed ones."""
    pairs = cooccurrence.PairTable(spark)
    for batch in _session_batches(table(spark, sf_dir, "sessions")):
        pairs.apply(cooccurrence.baskets_of(batch, "id", {"tag": "tags", "entity": "entities"}))
    return pairs


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurrence.associated(_pair_table(spark, sf_dir).pairs())
    return found.select(F.col("kind").alias("item_kind"), "item_a", "item_b")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its counts and its lift."""
    pairs = _pair_table(spark, sf_dir).pairs()
    return pairs.select(F.col("kind").alias("item_kind"), "item_a", "item_b", "n_ab", "n_baskets", F.round("lift", 6).alias("lift"))


def p4_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations recomputed after the last batch: of pairs that changed or that hold an item whose count did."""
    pairs = _pair_table(spark, sf_dir).affected()
    return pairs.select(F.col("kind").alias("item_kind"), "item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search once: ``day, week, duration_ms`` of the valid ones."""
    audit = table(spark, sf_dir, "query_audit").where("duration_ms >= 0 AND NOT isnan(duration_ms) AND created_at IS NOT NULL")
    once = audit.groupBy("id").agg(F.min(F.struct(epoch_ms("created_at").alias("at"), "duration_ms")).alias("x"))
    day = F.to_date(F.timestamp_millis("x.at"))
    return once.select(F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(F.trunc(day, "week"), "yyyy-MM-dd").alias("week"), "x.duration_ms")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(_durations(spark, sf_dir).select("day", "duration_ms"), "durations")  # read by the sketch and, for days within its bound, once more
    return quantiles.groups_above(rows, "day", "duration_ms", 0.95, 2000.0).select(F.col("grp").alias("day"))


PS = [0.5, 0.9, 0.95, 0.99, 0.999]


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and higher percentiles per day with the values at the ends of the error bound."""
    sketches = quantiles.build_sketches(_durations(spark, sf_dir), "day", "duration_ms")
    return quantiles.sketch_quantiles(sketches, PS)


def _weeks(days: DataFrame) -> DataFrame:
    """The sketches of single days merged to weeks."""
    return quantiles.merge_sketches(days.withColumn("grp", F.date_format(F.trunc(F.to_date("grp"), "week"), "yyyy-MM-dd")))


def p5_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per week, merged from the sketches of single days."""
    return quantiles.sketch_quantiles(_weeks(quantiles.build_sketches(_durations(spark, sf_dir), "day", "duration_ms")), PS)


def p5_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact percentiles of each day lie within the bounds of the sketch."""
    rows = staged(_durations(spark, sf_dir).select("day", "duration_ms"), "durations")
    found = quantiles.sketch_quantiles(quantiles.build_sketches(rows, "day", "duration_ms"), PS)
    return quantiles.bounds_kept(rows, found, "day", "duration_ms").withColumnRenamed("grp", "day")


def p5_week_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of weeks merged from days."""
    rows = staged(_durations(spark, sf_dir), "durations")
    found = quantiles.sketch_quantiles(_weeks(quantiles.build_sketches(rows, "day", "duration_ms")), PS)
    return quantiles.bounds_kept(rows, found, "week", "duration_ms").withColumnRenamed("grp", "week")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose parts the packing put into more than one container."""
    return packing.divided(packing.pack(table(spark, sf_dir, "documents"))).distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or part."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers hold, over all: nothing may be lost or overfull."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    full = packing.container_report(packed).agg(F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.max(F.col("tokens") > 8192).alias("overfull"))
    return full.select(F.col("tokens").cast("bigint").alias("tokens"), F.col("items").cast("bigint").alias("items"), "overfull")


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest container under each limit, and how many containers there are for the tokens: within 3 % and a few."""
    found = packing.limits_report(packing.pack(table(spark, sf_dir, "documents")), packing.Limits())
    most = F.when(F.col("limit_name") == "containers", F.col("allowed") * 1.03 + 3).otherwise(F.col("allowed"))
    return found.select("limit_name", "allowed", (F.col("largest") <= most).alias("kept"))


def _mixture(spark: SparkSession, sf_dir: str, hold: str = "targets") -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), hold=hold)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().where("short").select("mix_name", "source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and real share of each source."""
    return _mixture(spark, sf_dir).shares()


def p8_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of a mix whether it came as near to its target as documents allow, and within its repeats."""
    found = _mixture(spark, sf_dir).deviations()
    return found.select("mix_name", "source", "target_pct", "tokens", "aim", (F.col("off_tokens") <= F.col("allowed_off")).alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def p8_filled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mixes with the total held: what short sources can't give, the others do."""
    return _mixture(spark, sf_dir, "total").shares()


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mixture(spark, sf_dir).selection()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, sf_dir, "documents"), with_text=False)
    return splitting.unbroken_stretches(pieces)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every long text."""
    return splitting.split_documents(table(spark, sf_dir, "documents"))


def p9_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut text put together again from its pieces, and whether each piece keeps the limit and shares the overlap with the one before."""
    pieces = splitting.split_documents(table(spark, sf_dir, "documents")).withColumn("before", F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("piece_no")))
    new = F.substr("piece", F.coalesce(F.col("before") - F.col("start_char"), F.lit(0)).cast("int") + 1)  # what the piece before didn't hold
    shared = F.octet_length("piece") - F.octet_length(new)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("t")))), lambda x: x["t"]), "")  # pieces of one text
    rows = pieces.groupBy("doc_id").agg(whole.alias("text"), F.max("size").alias("largest"), F.bool_and(F.col("before").isNull() | shared.between(128, 131)).alias("shared"))
    return rows.select("doc_id", F.md5("text").alias("text_md5"), (F.col("largest") <= 2048).alias("within"), "shared")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p3_found, p3_redacted, p4_found, p4_pairs, p4_affected, p5_found, p5_percentiles, p5_weekly, p5_day_bounds, p5_week_bounds, p7_found, p7_containers, p7_totals, p7_limits,
        p8_found, p8_shares, p8_deviation, p8_filled_shares, p8_selection, p9_found, p9_pieces, p9_rebuilt,
    )
}
