"""Registered queries of the general data problems (sessions of activity, nested records) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.nested import block_table, line_table, shred_lines
from threadlake.operators.sessionize import line_instants, sessionize
from threadlake.session import table

IDLE_MS = 900_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sessionize(line_instants(table(spark, sf_dir, "messages")), "session_id", "ts_ms", IDLE_MS)
    return runs.select("session_id", "start_ms", "end_ms", F.col("n_events").alias("n_lines"))


def p2_activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the users' events, joined to the number of runs each user has."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_millis("ts").alias("ts_ms"))
    return sessionize(events, "user_id", "ts_ms", IDLE_MS)


def p2_session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per transcript: runs, active time, lines."""
    runs = sessionize(line_instants(table(spark, sf_dir, "messages")), "session_id", "ts_ms", IDLE_MS)
    return runs.groupBy("session_id").agg(
        F.count("*").alias("n_runs"), F.sum("duration_ms").alias("active_ms"), F.sum("n_events").alias("n_lines")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = block_table(shred_lines(table(spark, sf_dir, "raw_lines")))
    return blocks.select("line_id", "block_path", "parent_path", "block_type", "tool_ref")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks table with bodies."""
    return block_table(shred_lines(table(spark, sf_dir, "raw_lines")))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of text and thinking blocks, at any depth."""
    blocks = block_table(shred_lines(table(spark, sf_dir, "raw_lines"))).where("block_type IN ('text', 'thinking')")
    return blocks.select("line_id", "block_path", "depth", "position", F.md5("body").alias("body_md5"))


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines table."""
    return line_table(shred_lines(table(spark, sf_dir, "raw_lines"))).drop("n_blocks")


QUERIES = {
    f.__name__: f for f in (p2_found, p2_activity_sessions, p2_session_totals, p6_found, p6_blocks, p6_bodies, p6_lines)
}

_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
INSTANT = f"""CASE WHEN regexp_full_match(trim("timestamp"), '-?[0-9]+') THEN try_cast(trim("timestamp") AS BIGINT)
 WHEN regexp_matches(trim("timestamp"), '{_ISO}(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN epoch_ms(try_cast(trim("timestamp") AS TIMESTAMPTZ))
 WHEN regexp_matches(trim("timestamp"), '{_ISO}$') THEN epoch_ms(try_cast(trim("timestamp") || 'Z' AS TIMESTAMPTZ)) END"""


def _runs(key: str, source: str) -> str:
    return f"""WITH e AS ({source}),
c AS (SELECT {key}, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY {key} ORDER BY ts_ms) <= {IDLE_MS} THEN 0 ELSE 1 END AS cut FROM e),
r AS (SELECT {key}, ts_ms, sum(cut) OVER (PARTITION BY {key} ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS no FROM c),
runs AS (SELECT {key}, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, max(ts_ms) - min(ts_ms) AS duration_ms, count(*) AS n_events FROM r GROUP BY {key}, no)
"""


_LINES = f"SELECT session_id, line_no, min({INSTANT}) AS ts_ms FROM messages GROUP BY session_id, line_no HAVING min({INSTANT}) IS NOT NULL"

_BLOCKS = """WITH RECURSIVE ok AS (SELECT line_id, CAST(raw AS JSON) AS j FROM raw_lines WHERE json_valid(raw)),
msg AS (SELECT line_id, CASE json_type(j, '$.message') WHEN 'OBJECT' THEN j->'$.message'
  WHEN 'VARCHAR' THEN CASE WHEN json_valid(j->>'$.message') THEN CAST(j->>'$.message' AS JSON) END END AS m FROM ok WHERE json_type(j) = 'OBJECT'),
rec(line_id, block_path, parent_path, depth, position, block, content) AS (
  SELECT line_id, '', '', -1, -1, CAST(NULL AS JSON), m->'$.content' FROM msg WHERE json_type(m) = 'OBJECT'
  UNION ALL
  SELECT line_id, CASE WHEN depth < 0 THEN CAST(i - 1 AS VARCHAR) ELSE block_path || '.' || CAST(i - 1 AS VARCHAR) END, block_path, depth + 1, CAST(i - 1 AS INTEGER), e,
    CASE WHEN json_type(e) = 'OBJECT' AND e->>'$.type' = 'tool_result' THEN e->'$.content' END
  FROM (SELECT line_id, block_path, depth, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (
    SELECT line_id, block_path, depth, CASE json_type(content) WHEN 'ARRAY' THEN from_json(content, '["JSON"]')
      WHEN 'OBJECT' THEN CASE WHEN content = '{}' THEN [] ELSE [content] END
      WHEN 'VARCHAR' THEN CASE WHEN content->>'$' = '' THEN [] ELSE [content] END END AS es FROM rec WHERE content IS NOT NULL))),
blocks AS (SELECT line_id, block_path, parent_path, depth, position,
  CASE json_type(block) WHEN 'VARCHAR' THEN 'text' ELSE CASE WHEN json_type(block, '$.type') = 'VARCHAR' THEN block->>'$.type' ELSE '' END END AS block_type,
  block FROM rec WHERE depth >= 0 AND json_type(block) IN ('VARCHAR', 'OBJECT'))
"""
_REF = "coalesce(CASE block_type WHEN 'tool_use' THEN block->>'$.id' WHEN 'tool_result' THEN block->>'$.tool_use_id' END, '')"

SQL = {
    "p2_found": _runs("session_id", _LINES) + "SELECT session_id, start_ms, end_ms, n_events AS n_lines FROM runs",
    "p2_activity_sessions": _runs("user_id", "SELECT user_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE ts IS NOT NULL") + "SELECT * FROM runs",
    "p2_session_totals": _runs("session_id", _LINES)
    + "SELECT session_id, count(*) AS n_runs, CAST(sum(duration_ms) AS BIGINT) AS active_ms, CAST(sum(n_events) AS BIGINT) AS n_lines FROM runs GROUP BY session_id",
    "p6_found": _BLOCKS + f"SELECT line_id, block_path, parent_path, block_type, {_REF} AS tool_ref FROM blocks",
    "p6_bodies": _BLOCKS
    + """SELECT line_id, block_path, depth, position, md5(CASE json_type(block) WHEN 'VARCHAR' THEN block->>'$' ELSE CASE WHEN json_type(block, '$.' || block_type) = 'VARCHAR'
THEN CASE block_type WHEN 'text' THEN block->>'$.text' ELSE block->>'$.thinking' END END END) AS body_md5 FROM blocks WHERE block_type IN ('text', 'thinking')""",
    "p6_lines": """WITH j AS (SELECT line_id, coalesce(json_valid(raw), false) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' AS readable, raw FROM raw_lines),
o AS (SELECT line_id, coalesce(readable, false) AS readable, CASE WHEN readable THEN CAST(raw AS JSON) END AS o FROM j),
m AS (SELECT *, CASE json_type(o, '$.message') WHEN 'OBJECT' THEN o->'$.message' WHEN 'VARCHAR' THEN CASE WHEN json_valid(o->>'$.message') THEN CAST(o->>'$.message' AS JSON) END END AS m FROM o)
SELECT line_id, readable, o->>'$.type' AS line_type, o->>'$.timestamp' AS line_timestamp, o->>'$.cwd' AS cwd, m->>'$.role' AS role,
CAST(CASE json_type(m, '$.content') WHEN 'ARRAY' THEN len(list_filter(from_json(m->'$.content', '["JSON"]'), lambda x: json_type(x) IN ('VARCHAR', 'OBJECT')))
  WHEN 'OBJECT' THEN 1 WHEN 'VARCHAR' THEN CASE WHEN m->>'$.content' = '' THEN 0 ELSE 1 END ELSE 0 END AS INTEGER) AS n_top_blocks FROM m""",
}
