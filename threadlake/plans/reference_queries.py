"""Registered queries of the retrieval and analytics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions.instants import epoch_ms
from threadlake.functions.text import folded
from threadlake.operators import activity, browse, evaluation, fusion, lexical, maintenance, measures, reports, transcripts, vectors
from threadlake.operators.chunking import chunk_documents
from threadlake.operators.index import LexicalIndex
from threadlake.operators.nested import block_table, shred_lines
from threadlake.plans.gateway import run_select, star_tables
from threadlake.session import new_path, staged, stamp, table
from threadlake.streaming import activity as stream

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- transcripts


@query
def turn_filter(spark: SparkSession, d: str) -> DataFrame:
    """Turns that survive the noise filter and agree in role and type."""
    return transcripts.turns(transcripts.unique_lines(table(spark, d, "messages"))).select("session_id", "line_no", "role", F.md5("text").alias("text_md5"))


@query
def session_headers(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.session_headers(table(spark, d, "messages"))


@query
def indexable_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.indexable(transcripts.session_headers(table(spark, d, "messages"))).select("session_id", "n_user")


@query
def session_text(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.rendered_lines(table(spark, d, "messages"), markdown=False).select("session_id", "line_no", F.md5("line").alias("line_md5"))


@query
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.rendered_lines(table(spark, d, "messages"), markdown=True).select("session_id", "line_no", F.md5("line").alias("line_md5"))


@query
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(transcripts.strip_markup("text")).alias("text_md5"))


@query
def tool_summary(spark: SparkSession, d: str) -> DataFrame:
    blocks = block_table(shred_lines(table(spark, d, "raw_lines"))).where("block_type = 'tool_use' AND tool_name IS NOT NULL")
    return blocks.select("line_id", "block_path", transcripts.tool_summary(F.col("tool_name"), F.col("body")).alias("summary"))


@query
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", transcripts.preview("text").alias("preview"))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


def _tool_blocks(spark: SparkSession, d: str) -> DataFrame:
    return block_table(shred_lines(table(spark, d, "raw_lines")))


@query
def session_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole sessions in lines for an index: what was said and the calls of tools."""
    lines = transcripts.session_lines(table(spark, d, "messages"), _tool_blocks(spark, d), markdown=False)
    return lines.select("session_id", "line_no", "part_no", F.md5("line").alias("line_md5"))


@query
def session_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole sessions as Markdown: summary, head, turns, calls as quotes."""
    messages = table(spark, d, "messages")
    lines = transcripts.session_lines(messages, _tool_blocks(spark, d), True, transcripts.session_headers(messages))
    lines = transcripts.with_summaries(lines, reports.summary_header(table(spark, d, "sessions")))
    return lines.select("session_id", "line_no", "part_no", F.md5("line").alias("line_md5"))


@query
def chunk_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A session's chunks, by the id's first part."""
    chunks = table(spark, d, "chunks").select("id").distinct()
    return chunks.groupBy(transcripts.session_of_chunk("id").alias("session_id")).agg(F.count("*").alias("n_chunks"))


@query
def active_duration(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.unix_millis("ts").alias("ms"))
    return transcripts.active_duration(events, "user_id", "ms")


@query
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return chunk_documents(table(spark, d, "documents")).select("doc_id", "chunk_id", "seq", "pos", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# ---- lexical, vector and hybrid retrieval


def _asked(spark: SparkSession, d: str, text_only: bool = True) -> DataFrame:
    """The stated query set: every search whose id is divisible by 20, against all documents."""
    audit = table(spark, d, "query_audit").where("id % 20 = 0").groupBy("id").agg(F.min("query").alias("query"))
    return audit.select(F.col("id").alias("query_id"), "query")


_INDEXES: dict[tuple, LexicalIndex] = {}


def indexed(spark: SparkSession, d: str, docs: str = "documents", where: str = "true") -> LexicalIndex:
    """The stored index of a table of documents, keyed by session: built on first use, then opened as long as the table's files stay as they are."""
    path = f"{d}/{docs}.parquet"
    name = (spark.sparkContext.applicationId, path, where, stamp(spark, path))
    if name not in _INDEXES:
        index = LexicalIndex(spark, new_path(spark, "index", lasting=True))
        index.refresh(table(spark, d, docs).where(where), "session_id", "doc_id", "text")
        _INDEXES[name] = index
    return _INDEXES[name]


def _best(spark: SparkSession, d: str, **how) -> DataFrame:
    """The ten best documents of each search."""
    return lexical.bm25_top(indexed(spark, d), _asked(spark, d), "doc_id", "text", 10, **how)


@query
def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Documents per term and their counts from an index that was built without the newest sessions, with a stale text for others and with drafts, and then refreshed."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("session_id", F.lit("")).alias("session"), "text", "created_at")
    cut = docs.select(F.unix_millis("created_at").cast("double").alias("ms")).approxQuantile("ms", [0.6, 0.8], 0.05) or [0.0, 0.0]
    newest = docs.groupBy("session").agg(F.max(F.unix_millis("created_at")).alias("last"))
    old, stale = (newest.where(x).select("session") for x in (F.coalesce("last", F.lit(0)) <= cut[0], (F.col("last") > cut[0]) & (F.col("last") <= cut[1])))
    index = LexicalIndex(spark)
    drafts = docs.join(old, "session", "left_semi").select((-F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("draft "), "session").alias("session"), "text")
    first = docs.join(old, "session", "left_semi").select("doc_id", "session", "text")
    before = docs.join(stale, "session", "left_semi").select("doc_id", "session", F.concat(F.lit("stale words "), F.coalesce("text", F.lit(""))).alias("text"))
    index.refresh(first.unionByName(before).unionByName(drafts), "session", "doc_id", "text")
    changed = docs.join(old, "session", "left_anti").select("doc_id", "session", "text")
    index.refresh(changed, "session", "doc_id", "text", removed=drafts.select("session").distinct())
    return index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def search_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Every search of the set with its words joined by AND, OR or NOT, or with one of them left hanging, by the length of its text."""
    words = F.split(lexical.sanitize("query"), " ")
    n = F.length("query") % 4
    joined = F.when(n == 0, F.array_join(words, " AND ")).when(n == 1, F.array_join(words, " OR ")).when(n == 2, F.array_join(words, " NOT ")).otherwise(F.concat(F.array_join(words, " "), F.lit(" OR")))
    return lexical.bm25_top(indexed(spark, d), _asked(spark, d).withColumn("query", joined), "doc_id", "text", 10, mode="grammar")


@query
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    post = lexical.postings(table(spark, d, "documents"), "doc_id", "text")
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.corpus_stats(table(spark, d, "documents"), "text")
    return s.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    """Every search of the set, all terms required, ten best."""
    return _best(spark, d)


@query
def bm25_any(spark: SparkSession, d: str) -> DataFrame:
    """Any term suffices; split words instead of the strict grammar."""
    return _best(spark, d, mode="any", compat=False)


@query
def bm25_not(spark: SparkSession, d: str) -> DataFrame:
    """All terms, without the documents that hold "index"."""
    return _best(spark, d, exclude=_asked(spark, d).select("query_id", F.lit("index").alias("term")))


@query
def highlight_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents"), _asked(spark, d)
    top = _best(spark, d)
    terms = lexical.query_terms(asked).groupBy("query_id").agg(F.collect_set("term").alias("terms"))  # terms of one query text
    rows = top.select("query_id", "doc_id").join(terms, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return lexical.highlight(rows, "text", "terms").select("query_id", "doc_id", "snippet")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.knn(table(spark, d, "embeddings"), _vector_queries(spark, d), 10)
    return near.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"))


def _hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    """Searches with a vector each: the stored one at id modulo the number of vectors, vectors numbered in the order of their ids."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = emb.count()
    # Ids may have gaps: they are numbered by ranges, each behind the vectors of the ranges before it.
    ranged = emb.repartitionByRange("vec_id").sortWithinPartitions("vec_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = staged(ranged, "numbered")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("lo"))
    before = parts.select("part", "lo", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row per range
    numbered = ranged.join(F.broadcast(before), "part").select((F.col("at") - F.col("lo") + F.col("offset")).alias("place"), "embedding")
    return staged(_asked(spark, d).withColumn("place", F.pmod("query_id", F.lit(n))).join(numbered, "place").drop("place"), "asked")  # read by both sides


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("project", F.lit("")).alias("project"), "text")


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    asked = _hybrid_queries(spark, d)
    lex = lexical.bm25_top(indexed(spark, d), asked, "doc_id", "text", 50, digits=9).withColumnRenamed("rk", "bm25_rk")
    vec = vectors.knn(table(spark, d, "embeddings"), asked, 50).select("query_id", F.col("id").alias("doc_id"), F.col("rk").alias("knn_rk"))
    return fusion.fuse(lex, vec).select("query_id", "doc_id", "bm25_rk", "knn_rk", F.round("score", 9).alias("score"))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.hybrid_search(_projects(spark, d), table(spark, d, "embeddings"), _hybrid_queries(spark, d), index=indexed(spark, d))
    return found.select("query_id", "project", "doc_id", F.round("score", 9).alias("score"), "place")


@query
def hybrid_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The best sessions of each search with their fields and the best document's preview."""
    docs = table(spark, d, "documents").select("doc_id", "session_id", "text")
    found = fusion.hybrid_search(docs, table(spark, d, "embeddings"), _hybrid_queries(spark, d), group="session_id", index=indexed(spark, d))
    rows = fusion.with_session(found, docs, table(spark, d, "sessions"))
    return rows.select("query_id", "session_id", "doc_id", F.round("score", 9).alias("score"), "place", "project", "date", "title", F.md5("preview").alias("preview_md5"))


@query
def query_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all searches by way of a cache that holds the texts of even length."""
    asked = table(spark, d, "query_audit").groupBy("id").agg(F.min("query").alias("query")).select(F.col("id").alias("query_id"), "query")
    empty = spark.createDataFrame([], "query_hash string, embedding array<float>")
    _, cache = vectors.cached_vectors(asked.where(F.length("query") % 2 == 0), empty, vectors.hashed_embedding)
    found, _ = vectors.cached_vectors(asked, cache, vectors.hashed_embedding)
    return found.select("query_id", "hit", F.size("embedding").alias("dims"))


@query
def summary_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of summary chunks: those of sessions up to "8" are stored, the pending ones are embedded and replace what their sessions had."""
    chunks = table(spark, d, "chunks").where("session_id IS NOT NULL")
    some = chunks.where("seq = -1 AND text IS NOT NULL").select("id", "text").distinct()
    stored = vectors.hashed_embedding(some.where("id <= '8'"), "id", "text")
    new = vectors.embed_pending(chunks, stored, vectors.hashed_embedding)
    whole = maintenance.replace_rows(stored.withColumn("session_id", transcripts.session_of_chunk("id")), new.withColumn("session_id", transcripts.session_of_chunk("id")), "session_id")
    return whole.select("id", "session_id", F.size("embedding").alias("dims"))


@query
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Filtered after retrieval: English documents of 2026-01 on."""
    keep = table(spark, d, "documents").where((folded("lang") == "en") & (F.col("created_at") >= "2026-01-15")).select("doc_id")
    found = fusion.hybrid_search(_projects(spark, d), table(spark, d, "embeddings"), _hybrid_queries(spark, d), keep=keep, index=indexed(spark, d))
    return found.select("query_id", "project", "doc_id", F.round("score", 9).alias("score"), "place")


@query
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every twentieth document under the feature-hashing embedding."""
    emb = vectors.hashed_embedding(table(spark, d, "documents"), "doc_id", "text")
    near = vectors.knn(emb, emb.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, id_col="id")
    return near.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"))


# ---- browsing and filters


@query
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.page(table(spark, d, "sessions"), 100, 20).select("id", "project", "date", "title")


@query
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sessions").where(browse.date_between(lo="2026-01-10", hi="2026-01-31") & browse.like_folded(F.col("project"), "e"))
    return rows.agg(F.count("*").alias("n"))


@query
def filter_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where(browse.has_tag("session")).select("id")


@query
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where(browse.like_folded(F.col("project"), "RAL")).select("id", "project")


@query
def filter_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where(browse.date_between(day="2026-01-12")).select("id", "date")


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return browse.status(table(spark, d, "sessions"), table(spark, d, "chunks"), table(spark, d, "query_audit"))


@query
def projects_recent(spark: SparkSession, d: str) -> DataFrame:
    return browse.projects(table(spark, d, "sessions"))


@query
def heatmap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return browse.filled_calendar(browse.daily(table(spark, d, "sessions")))


@query
def heatmap_hours(spark: SparkSession, d: str) -> DataFrame:
    return browse.filled_calendar(browse.daily(table(spark, d, "sessions"), hours=True))


@query
def heatmap_intensity(spark: SparkSession, d: str) -> DataFrame:
    return browse.intensity(browse.filled_calendar(browse.daily(table(spark, d, "sessions"))))


@query
def heatmap_totals(spark: SparkSession, d: str) -> DataFrame:
    return browse.heatmap_totals(browse.daily(table(spark, d, "sessions"), hours=True))


@query
def heatmap_by_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where("date != ''").groupBy("date", "project").agg(F.count("*").alias("n"))


@query
def heatmap_project(spark: SparkSession, d: str) -> DataFrame:
    """The heatmap of one project, the first by name."""
    s = table(spark, d, "sessions")
    first = s.where("project != ''").agg(F.min("project").alias("project"))  # one row
    return browse.filled_calendar(browse.daily(s.join(F.broadcast(first), "project", "left_semi")))


@query
def heatmap_weekly(spark: SparkSession, d: str) -> DataFrame:
    return browse.weekly(table(spark, d, "sessions"))


@query
def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return browse.distinct_items(table(spark, d, "sessions"))


# ---- index maintenance and enrichment


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the sessions, each in one at least: the stored one lacks some that are new, the fresh one some that weren't touched; a third of the fresh ones has new hashes."""
    s = table(spark, d, "sessions").withColumn("no", F.coalesce(F.conv(F.substring("id", 1, 6), 16, 10).cast("bigint"), F.lit(0)))
    fresh = s.where("no % 7 != 0").select("id", "path", "project", "date", F.concat("title", F.lit(" (again)")).alias("title"), F.when(F.col("no") % 3 == 0, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"), (F.col("indexed_at") + 1).alias("indexed_at"))
    return s.where("no % 7 = 0 OR no % 5 != 0").drop("no"), fresh


@query
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    stored, fresh = _versions(spark, d)
    return maintenance.upsert(stored, fresh).select("id", "title", "hash", "indexed_at", "summary", F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("n_tags"), "enriched_at", "enrichment_version")


@query
def hash_changed(spark: SparkSession, d: str) -> DataFrame:
    stored, fresh = _versions(spark, d)
    return maintenance.changed(fresh, stored).select("id", "hash")


@query
def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after the sessions with a new summary chunk were replaced as a whole."""
    chunks = table(spark, d, "chunks").dropDuplicates(["id"]).select("id", "session_id", "seq", "pos", "text")
    fresh = maintenance.summary_chunks(maintenance.without_summary_chunk(table(spark, d, "sessions"), chunks))
    return maintenance.replace_rows(chunks, fresh, "session_id").select("id", "session_id", "seq", F.md5("text").alias("text_md5"))


@query
def backfill_anti(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.without_summary_chunk(table(spark, d, "sessions"), table(spark, d, "chunks")).select("id")


@query
def summary_chunk(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.summary_chunks(table(spark, d, "sessions")).select("id", "session_id", "seq", F.md5("text").alias("text_md5"))


@query
def pending_enrich(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.pending_enrichment(table(spark, d, "sessions"), older_than_ms=1_769_500_000_000).select("id")


@query
def digest_cut(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.digest(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "kept", "cut", F.md5("digest").alias("digest_md5"))


@query
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    return maintenance.parse_reply(docs, "text").select("doc_id", "title", F.md5("summary").alias("summary_md5"), F.size("tags").alias("n_tags"))


@query
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The newest copy of each line."""
    log = table(spark, d, "messages").select("session_id", "line_no", "line_id", "type")
    return maintenance.last_wins(log, ["session_id", "line_no"], "line_id")


@query
def live_over_archive(spark: SparkSession, d: str) -> DataFrame:
    stored, fresh = _versions(spark, d)
    return maintenance.latest_by_priority(fresh.select("id", "title"), stored.select("id", "title"), "id")


@query
def project_cap_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: a hundred sessions, of a project at most its share and three at least."""
    return maintenance.capped_sample(table(spark, d, "sessions").select("id", "project"), "project", "id")


# ---- activity and measures


@query
def activity_groups(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("log", "kind", "start_no", "complete", "running", "n_items")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a log per user: signup starts the daemon, view an index run (purchase ends it), error an enrich run."""
    as_type = F.create_map(*[F.lit(x) for kv in {"signup": "daemon_started", "view": "index_started", "purchase": "index_complete", "error": "enrich_started", "click": "session_indexed"}.items() for x in kv])
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("log"), "ts", as_type[F.col("event_type")].alias("type"))
    return activity.run_groups(events)


@query
def activity_collapsed(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    empty = (F.col("kind") == "index") & ~F.col("running") & (F.col("n_items") == 0)
    return activity.collapse_empty(runs, empty, [F.col("closed").asc_nulls_last(), F.col("kind").desc(), F.col("start_no")], block=F.to_date("closed.ts")).select("log", "first_no", "n_runs", "n_items", "collapsed")


@query
def activity_feed(spark: SparkSession, d: str) -> DataFrame:
    """The collapsed runs with their labels, after stale ones were closed as of the last event."""
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return activity.activity_feed(activity.close_stale(_runs(spark, d), F.lit(now)))


@query
def metric_last_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return measures.last_per_bucket(table(spark, d, "events"), "event_type", "ts", "value", "day")


@query
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    days = measures.last_per_bucket(table(spark, d, "events"), "event_type", "ts", "value", "day")
    return measures.deltas(days, "event_type").select("event_type", "bucket", "value", F.round("delta", 6).alias("delta"))


@query
def metric_changes(spark: SparkSession, d: str) -> DataFrame:
    days = measures.last_per_bucket(table(spark, d, "events"), "event_type", "ts", "value", "week")
    return measures.changes(measures.deltas(days, "event_type"), 5.0, "up").select("event_type", "bucket", F.round("delta", 6).alias("delta"))


@query
def finished_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the enrichment queue without a chunk of text, marked as done."""
    queue = maintenance.pending_enrichment(table(spark, d, "sessions"))
    return maintenance.finished_without_chunks(queue, table(spark, d, "chunks"), 1_770_200_000_000).select("id", "enriched_at", "enrichment_version")


@query
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Values out of raw lines by paths with a list index, a chosen element and a default."""
    raw = table(spark, d, "raw_lines").where("try_parse_json(raw) IS NOT NULL")
    paths = {"first_type": "message.content.0.type", "result_id": "message.content[type=tool_result].tool_use_id", "role": "message.role"}
    found = [measures.json_path(F.col("raw"), p, "none" if n == "role" else None).alias(n) for n, p in paths.items()]
    return raw.select("line_id", *found)


@query
def regex_values(spark: SparkSession, d: str) -> DataFrame:
    """A number and what follows it, out of every document."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", measures.cast_value(measures.regex_value(F.col("text"), r"([0-9]{1,6})\s+([a-z]+)"), "int").alias("n"), measures.regex_value(F.col("text"), r"([0-9]{1,6})\s+([a-z]+)", 2).alias("unit"))


@query
def jsonpath_extract(spark: SparkSession, d: str) -> DataFrame:
    raw = measures.json_path(F.col("props"), "k")
    value = measures.cast_value(raw, "money_cents")
    return table(spark, d, "events").select("event_id", value.alias("value"), measures.checked(value, 0.1, 0.9).alias("status"))


# ---- retrieval quality


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sessions retrieved for each search (best document of a session) and the one it was after."""
    docs = indexed(spark, d, where="session_id IS NOT NULL")
    found = lexical.bm25_top(docs, _asked(spark, d), "doc_id", "text", 50, mode="any", compat=False, by="session_id")
    retrieved = found.select("query_id", F.col("session_id").alias("item"), "rk")
    relevant = table(spark, d, "query_audit").where("id % 20 = 0 AND top_session_id IS NOT NULL").select(F.col("id").alias("query_id"), F.col("top_session_id").alias("item")).distinct()
    return retrieved, relevant


@query
def eval_found_ndcg(spark: SparkSession, d: str) -> DataFrame:
    per = evaluation.quality(*_judged(spark, d))
    return per.select("query_id", "found", F.round("ndcg", 6).alias("ndcg"))


@query
def eval_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Measures over the searches alone whose session is in the index."""
    retrieved, relevant = _judged(spark, d)
    have = table(spark, d, "documents").where("session_id IS NOT NULL").select(F.col("session_id").alias("item"))
    return evaluation.summary(evaluation.quality(retrieved, evaluation.indexed_only(relevant, have)))


@query
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(evaluation.quality(*_judged(spark, d)))


@query
def eval_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").where("session_id IS NOT NULL").groupBy(F.col("session_id").alias("item")).agg(F.count("*").alias("n_chunks"))
    return evaluation.diagnosis(*_judged(spark, d), sizes).groupBy("diagnosis").agg(F.count("*").alias("n"))


@query
def eval_percentiles(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "query_audit").where("duration_ms >= 0 AND NOT isnan(duration_ms)").groupBy("id").agg(F.min("duration_ms").alias("ms"), F.min("k").alias("k"))
    p = evaluation.latency_percentiles(ok, "ms", (0.5, 0.95), "k")
    return p.select("k", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query
def audit_recent(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest searches (a report)."""
    once = table(spark, d, "query_audit").groupBy("id").agg(F.min(epoch_ms("created_at")).alias("at"), F.min("query").alias("query"))
    return once.orderBy(F.col("at").desc(), "id").limit(100)


# ---- SQL gateway over the star tables: the same text in both engines

GATEWAY = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_join_inner": """SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_join_full": "SELECT c_nationkey, s_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer) c FULL JOIN (SELECT s_nationkey FROM supplier) s ON c_nationkey = s_nationkey GROUP BY c_nationkey, s_nationkey",
    "sql_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "sql_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100",
    "sql_distinct_agg": "SELECT l_shipyear AS y, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM (SELECT year(l_shipdate) AS l_shipyear, l_partkey, l_suppkey FROM lineitem) x GROUP BY l_shipyear",
    "sql_rank": "SELECT c_custkey, c_nationkey, rk FROM (SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer) x WHERE rk <= 3",
    "sql_frame": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent FROM orders",
    "sql_ntile": "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part",
    "sql_union": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sql_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice = (SELECT max(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sql_case": "SELECT CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY 1",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
}
_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _gateway(sql: str):
    return lambda spark, d: run_select(spark, sql, star_tables(spark, d, tuple(t for t in _STAR if t in sql)))


QUERIES |= {name: _gateway(sql) for name, sql in GATEWAY.items()}


# ---- streams over the events, run to the end


def _events(spark: SparkSession, d: str) -> DataFrame:
    return stream.event_stream(spark, f"{d}/events.parquet")


@query
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = stream.run_available(stream.tumbling(_events(spark, d), "1 hour"), "tumbling", ("window", "event_type"))
    return out.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def stream_sessionize(spark: SparkSession, d: str) -> DataFrame:
    out = stream.run_available(stream.sessions(_events(spark, d), "15 minutes"), "sessions_stream")
    return out.select("user_id", (F.unix_micros("session_window.start")).alias("start_us"), "n")
