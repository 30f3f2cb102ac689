"""Registered queries of the reports, each beside its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import browse, evaluation, lexical, measures, reports
from threadlake.operators.nested import block_table, shred_lines
from threadlake.plans.problem_queries import _BLOCKS
from threadlake.plans.reference_queries import _asked, _best, _events, _judged
from threadlake.plans.reference_sql import _JUDGED, _LASTS, _TEN, _bm25
from threadlake.session import table
from threadlake.streaming import activity as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = dt.date(2026, 2, 4)  # stands for the clock, so that results are fixed
NOW_MS = 1_770_200_000_000


def query(sql: str):
    def take(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


@query(f"""SELECT id, CASE WHEN d < 60 THEN 'just now' WHEN d < 3600 THEN (d // 60) || 'm ago' WHEN d < 86400 THEN (d // 3600) || 'h ago' ELSE (d // 86400) || 'd ago' END AS age
FROM (SELECT id, CAST(floor(({NOW_MS} - last_message_at) / 1000) AS BIGINT) AS d FROM sessions WHERE last_message_at IS NOT NULL)""")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where("last_message_at IS NOT NULL").select("id", reports.relative_time("last_message_at", NOW_MS).alias("age"))


@query("""SELECT id, CASE WHEN ms < 1000 THEN CAST(round(ms) AS BIGINT) || 'ms' ELSE (t // 10) || '.' || (t % 10) || 's' END AS took
FROM (SELECT id, min(duration_ms) AS ms, CAST(round(min(duration_ms) / 100) AS BIGINT) AS t FROM query_audit WHERE duration_ms >= 0 AND NOT isnan(duration_ms) GROUP BY id)""")
def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "query_audit").where("duration_ms >= 0 AND NOT isnan(duration_ms)").groupBy("id").agg(F.min("duration_ms").alias("ms"))
    return once.select("id", reports.duration_text("ms").alias("took"))


@query("""SELECT project, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(project, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS hash
FROM (SELECT DISTINCT project FROM sessions WHERE project <> '')""")
def project_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where("project != ''").select("project").distinct().select("project", reports.rolling_hash("project").alias("hash"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS text_md5 FROM documents")
def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(reports.html_escape("text")).alias("text_md5"))


@query("SELECT doc_id, substring(sha256(concat_ws('|', project, source, text)), 1, 16) AS cache_key FROM documents")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", reports.fingerprint("project", "source", "text").alias("cache_key"))


@query("""WITH p AS (SELECT 'today' AS preset, '2026-02-04' AS lo UNION ALL SELECT 'week', '2026-02-01' UNION ALL SELECT 'month', '2026-02-01')
SELECT preset, count(id) AS n FROM p LEFT JOIN sessions ON date >= lo AND date <= '2026-02-04' GROUP BY 1""")
def date_presets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    bounds = {p: reports.date_preset(p, TODAY) for p in ("today", "week", "month")}
    counts = s.agg(*[F.count_if(browse.date_between(lo=lo, hi=hi)).alias(p) for p, (lo, hi) in bounds.items()])
    return counts.unpivot([], list(bounds), "preset", "n")


@query("""SELECT date, count(*) AS n FROM sessions WHERE date >= '2026-02-02' AND date <= '2026-02-08' GROUP BY 1""")
def current_week(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each day of the week from Monday."""
    monday = TODAY - dt.timedelta(days=TODAY.weekday())
    return table(spark, d, "sessions").where(browse.date_between(lo=monday.isoformat(), hi=(monday + dt.timedelta(days=6)).isoformat())).groupBy("date").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT cwd, regexp_replace(cwd, '/+$', '') AS d FROM messages WHERE regexp_matches(cwd, '\\S')),
a AS (SELECT cwd, d, array_to_string(ps[1:i], '/') AS dir FROM (SELECT cwd, d, string_split(d, '/') AS ps, unnest(range(1, len(string_split(d, '/')) + 1)) AS i FROM c)),
k AS (SELECT *, CASE WHEN length(dir) % 5 = 0 THEN 1 WHEN length(dir) % 3 = 0 THEN 0 END AS agent FROM a WHERE dir <> ''),
b AS (SELECT cwd, arg_max(dir, (agent, length(dir))) AS dir FROM k WHERE agent IS NOT NULL GROUP BY 1)
SELECT c.cwd, string_split(coalesce(b.dir, c.d), '/')[-1] AS project FROM c LEFT JOIN b USING (cwd)""")
def project_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Projects of working directories; the markers stand at directories whose path length divides by five or three."""
    cwd = table(spark, d, "messages").select("cwd")
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    dirs = cwd.distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir")).where("dir != ''").distinct()
    kind = F.when(F.length("dir") % 5 == 0, "agent").when(F.length("dir") % 3 == 0, "git")
    return reports.resolve_projects(cwd, dirs.select("dir", kind.alias("kind")).where("kind IS NOT NULL"))


@query(_BLOCKS + """, x AS (SELECT line_id, position, block_type, CASE json_type(block) WHEN 'VARCHAR' THEN block->>'$' ELSE CASE block_type WHEN 'text' THEN CASE WHEN json_type(block, '$.text') = 'VARCHAR' THEN block->>'$.text' END
  WHEN 'thinking' THEN CASE WHEN json_type(block, '$.thinking') = 'VARCHAR' THEN block->>'$.thinking' END END END AS body FROM blocks WHERE depth = 0)
SELECT line_id, md5(coalesce(string_agg(body, chr(10) ORDER BY position) FILTER (block_type = 'text' AND body <> ''), '')) AS text_md5,
md5(coalesce(string_agg(body, chr(10) ORDER BY position) FILTER (block_type = 'thinking' AND body <> ''), '')) AS thinking_md5,
count(*) FILTER (block_type = 'tool_use') AS n_tools, count(*) FILTER (block_type = 'tool_result') = count(*) AS only_results FROM x GROUP BY 1""")
def line_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.line_texts(block_table(shred_lines(table(spark, d, "raw_lines"))))
    return rows.select("line_id", F.md5("text").alias("text_md5"), F.md5("thinking").alias("thinking_md5"), "n_tools", "only_results")


@query("""SELECT id, md5('## Summary' || chr(10) || chr(10) || summary || chr(10) || chr(10) || ls || CASE WHEN ls <> '' THEN chr(10) ELSE '' END || '---' || chr(10)) AS header_md5
FROM (SELECT id, summary, CASE WHEN len(tags) > 0 THEN '**Tags:** ' || array_to_string(tags, ', ') || chr(10) ELSE '' END
 || CASE WHEN len(entities) > 0 THEN '**Entities:** ' || array_to_string(entities, ', ') || chr(10) ELSE '' END AS ls FROM sessions WHERE summary <> '')""")
def summary_headers(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_header(table(spark, d, "sessions")).select("id", F.md5("header").alias("header_md5"))


@query("""WITH r AS (SELECT id, length(id || coalesce(path, '')) % 3 = 0 AS hit, CASE WHEN starts_with(id, 'a') THEN '' ELSE upper(title) END AS t FROM sessions)
SELECT s.id, CASE WHEN hit AND t <> '' THEN t ELSE title END AS title, CASE WHEN hit THEN 'again' ELSE summary END AS summary,
CASE WHEN hit THEN 1770200000000 ELSE enriched_at END AS enriched_at, CASE WHEN hit THEN 3 ELSE enrichment_version END AS enrichment_version FROM sessions s JOIN r USING (id)""")
def enrich_apply(spark: SparkSession, d: str) -> DataFrame:
    """Replies for the sessions whose id and path have a length that three divides; those from 'a' on bring no title."""
    s = table(spark, d, "sessions")
    hit = F.length(F.concat("id", F.coalesce("path", F.lit("")))) % 3 == 0
    replies = s.where(hit).select("id", F.when(F.col("id").startswith("a"), "").otherwise(F.upper("title")).alias("title"), F.lit("again").alias("summary"))
    return reports.enrich(s, replies, 3, NOW_MS).select("id", "title", "summary", "enriched_at", "enrichment_version")


@query("""WITH a AS (SELECT id FROM sessions ORDER BY md5(id || '|7'), id LIMIT 30)
SELECT id FROM a UNION ALL SELECT id FROM (SELECT id FROM sessions WHERE id NOT IN (SELECT id FROM a) ORDER BY md5(id || '|8'), id LIMIT 10)""")
def sample_filled(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: thirty sessions, then ten more under the next seed."""
    ids = table(spark, d, "sessions").select("id")
    return reports.filled_up(ids, reports.seeded_sample(ids, "id", 30, 7), "id", 10, 7)


@query("SELECT id, date FROM sessions ORDER BY coalesce(last_message_at, indexed_at) DESC, id LIMIT 5")
def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The five newest sessions (a report)."""
    return browse.page(table(spark, d, "sessions"), 5).select("id", "date")


@query("SELECT id FROM sessions WHERE id NOT IN (SELECT session_id FROM documents WHERE session_id IS NOT NULL)")
def ids_missing(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that have no document yet."""
    return table(spark, d, "sessions").select("id").join(table(spark, d, "documents").select(F.col("session_id").alias("id")), "id", "left_anti")


@query("WITH " + _bm25(True, True) + ", ten AS (" + _TEN.format("found") + """)
SELECT q.query_id, count(rk) AS result_count, arg_min(doc_id, rk) AS top_id, min(rank) AS top_score FROM (SELECT DISTINCT id AS query_id FROM query_audit WHERE id % 20 = 0) q LEFT JOIN ten USING (query_id) GROUP BY 1""")
def audit_entries(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_entries(_best(spark, d), _asked(spark, d))


@query("WITH " + _bm25(True, True, "(SELECT * FROM documents WHERE session_id IS NOT NULL)") + """,
b AS (SELECT query_id, session_id, min(round(rank, 6)) AS rank FROM found JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, session_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, session_id) AS rk FROM b) WHERE rk <= 10""")
def session_max(spark: SparkSession, d: str) -> DataFrame:
    """The ten best sessions of each search by their best document."""
    docs = table(spark, d, "documents").where("session_id IS NOT NULL")
    return lexical.bm25_top(docs, _asked(spark, d), "doc_id", "text", 10, by="session_id")


@query("""WITH o AS (SELECT id, min(k) AS k, min(result_count) AS n, min(CASE WHEN duration_ms >= 0 AND NOT isnan(duration_ms) THEN duration_ms END) AS ms FROM query_audit GROUP BY id)
SELECT k, count(*) AS searches, count(*) FILTER (n = 0) AS empty, round(sum(ms), 2) AS total_ms FROM o GROUP BY k""")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_totals(table(spark, d, "query_audit"), "k").withColumn("total_ms", F.round("total_ms", 2))


@query(f"""SELECT bucket, array_to_string(list_sort(list(event_type)), ', ') AS failed, count(*) AS n_failed FROM ({_LASTS.format('day')}) WHERE value IS NULL OR value < 5 OR value > 80 GROUP BY 1""")
def alert_failures(spark: SparkSession, d: str) -> DataFrame:
    days = measures.last_per_bucket(table(spark, d, "events"), "event_type", "ts", "value", "day")
    return reports.failure_alerts(days.withColumn("status", measures.checked(F.col("value"), 5, 80)), name="event_type")


@query(f"""SELECT event_type, bucket, CASE WHEN c IS NULL THEN 'first' ELSE CASE WHEN c < 0 THEN '-' ELSE '+' END || (abs(c) // 100) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') END AS change
FROM (SELECT event_type, bucket, CAST(round((value - lag(value) OVER (PARTITION BY event_type ORDER BY bucket)) * 100) AS BIGINT) AS c FROM ({_LASTS.format('week')}))""")
def alert_digest(spark: SparkSession, d: str) -> DataFrame:
    return reports.digest_alerts(measures.last_per_bucket(table(spark, d, "events"), "event_type", "ts", "value", "week"), "event_type")


@query(_JUDGED + "SELECT CASE WHEN round(avg(ndcg), 4) >= 0.5 THEN 'pass' WHEN round(avg(ndcg), 4) >= 0.5 * 0.93 THEN 'close' ELSE 'fail' END AS ndcg_grade FROM q")
def quality_grade(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(evaluation.quality(*_judged(spark, d))).select(reports.grade("ndcg_at_k", 0.5).alias("ndcg_grade"))


@query(r"""SELECT id, project, date, CAST(i - 1 AS INTEGER) AS place, query FROM (SELECT id, project, date, unnest(questions) AS query, generate_subscripts(questions, 1) AS i FROM sessions) WHERE regexp_matches(query, '\S')""")
def question_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.question_rows(table(spark, d, "sessions"))


@query("SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, event_type, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1, 2")
def stream_daily_last(spark: SparkSession, d: str) -> DataFrame:
    out = stream.run_available(stream.last_values(_events(spark, d), "1 day"), "daily_last", ("window", "event_type"))
    return out.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "value")


@query("""SELECT epoch_ms(w) AS start_ms, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i FOR i IN range(4)]) AS w FROM events) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = stream.run_available(stream.tumbling(_events(spark, d), "1 hour", slide="15 minutes"), "sliding", ("window", "event_type"))
    return out.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n")
