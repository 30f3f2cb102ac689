"""SQL of the registered retrieval and analytics queries."""

from threadlake.operators.lexical import ACCENTED, B, K1, PLAIN
from threadlake.operators.transcripts import TOOL_FIELD
from threadlake.plans.problem_queries import _BLOCKS, INSTANT
from threadlake.plans.reference_queries import GATEWAY

_WS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
_MARKUP = f"regexp_replace(regexp_replace(regexp_replace({{0}}, '<[^>]+>[\\s\\S]*?</[^>]+>', '', 'g'), '<[^>]+/>', '', 'g'), '{_WS}', '', 'g')"
_LINES = f"""WITH c AS (SELECT *, {INSTANT} AS ms, row_number() OVER (PARTITION BY session_id, line_no ORDER BY line_id) AS copy FROM messages),
l AS (SELECT * FROM c WHERE copy = 1),
talk AS (SELECT * FROM l WHERE NOT coalesce("type" IN ('file-history-snapshot', 'system', 'progress'), false) AND NOT coalesce(ismeta, false) AND NOT coalesce(issidechain, false)),
t0 AS (SELECT *, CASE WHEN role = 'user' THEN {_MARKUP.format('content_text')} ELSE regexp_replace(content_text, '{_WS}', '', 'g') END AS txt FROM talk
  WHERE "type" IN ('user', 'assistant') AND role = "type" AND regexp_matches(content_text, '\\S')),
t AS (SELECT * FROM t0 WHERE txt <> '')
"""
_HEADS = (
    _LINES
    + """, heads AS (SELECT session_id, arg_min(ms, line_no) FILTER (ms IS NOT NULL) AS first_ms, arg_min(cwd, line_no) FILTER (regexp_matches(cwd, '\\S')) AS cwd FROM talk GROUP BY 1),
said AS (SELECT session_id, arg_min(txt, line_no) FILTER (role = 'user') AS first_text, count(*) FILTER (role = 'user') AS n_user, count(*) AS n_turns FROM t GROUP BY 1),
gaps AS (SELECT session_id, ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) AS gap FROM l WHERE ms IS NOT NULL),
dur AS (SELECT session_id, CAST(round(coalesce(sum(CASE WHEN gap > 900000 THEN 900000 ELSE gap END), 0) / 1000) AS BIGINT) AS duration_seconds FROM gaps GROUP BY 1),
every AS (SELECT session_id, max(ms) AS last_message_at, count(*) AS n_lines FROM l GROUP BY 1),
h AS (SELECT session_id, substring(first_text, 1, 120) AS title, coalesce(strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d'), '') AS date,
  coalesce(string_split(regexp_replace(cwd, '/+$', ''), '/')[-1], '') AS project, coalesce(n_user, 0) AS n_user, coalesce(n_turns, 0) AS n_turns, n_lines, last_message_at,
  coalesce(duration_seconds, 0) AS duration_seconds FROM every LEFT JOIN heads USING (session_id) LEFT JOIN said USING (session_id) LEFT JOIN dur USING (session_id))
"""
)


def _toks(col: str) -> str:
    return f"regexp_extract_all(translate(lower({col}), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


_CLEAN = r"trim(regexp_replace(regexp_replace(query, '[^a-zA-Z0-9\s''-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _bm25(all_terms: bool, compat: bool, docs: str = "documents") -> str:
    """CTEs up to ``found`` (query_id, doc_id, rank)."""
    return f"""docs AS (SELECT * FROM {docs}),
asked AS (SELECT id AS query_id, min(query) AS query FROM query_audit WHERE id % 20 = 0 GROUP BY 1),
clean AS (SELECT query_id, {_CLEAN} AS q FROM asked),
qt0 AS (SELECT query_id, unnest({_toks('q')}) AS term FROM clean WHERE q <> '' {"AND NOT regexp_matches(q, '[''-]')" if compat else ""}),
qt1 AS (SELECT query_id, term, count(*) AS qtf FROM qt0 GROUP BY 1, 2),
qt AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qt1),
dt AS (SELECT doc_id, coalesce({_toks('text')}, []) AS toks FROM docs),
st AS (SELECT count(*) AS n_docs, avg(len(toks) + 1) AS avgdl FROM dt),
post0 AS (SELECT doc_id, len(toks) + 1 AS dl, unnest(toks) AS term FROM dt),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM post0 GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
hit AS (SELECT qt.query_id, post.doc_id, n_terms, qtf * (CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END)
  * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl)) AS s FROM qt JOIN post USING (term) JOIN df USING (term) CROSS JOIN st),
found AS (SELECT query_id, doc_id, -sum(s) AS rank FROM hit GROUP BY query_id, doc_id{', n_terms HAVING count(*) = n_terms' if all_terms else ''})
"""


_TEN = """SELECT query_id, doc_id, rank, rk FROM (SELECT query_id, doc_id, round(rank, 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 6), doc_id) AS rk FROM {0}) WHERE rk <= 10"""


def _knn(queries: str, k: int) -> str:
    """CTE ``near`` (query_id, doc_id, distance, knn_rk)."""
    return f"""vq AS ({queries}),
vd AS (SELECT query_id, vec_id AS doc_id, 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS distance
  FROM (SELECT query_id, vec_id, CAST(vq.embedding AS DOUBLE[]) AS a, CAST(embeddings.embedding AS DOUBLE[]) AS b FROM vq CROSS JOIN embeddings)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), doc_id) AS knn_rk FROM vd) WHERE knn_rk <= {k})
"""


_HYBRID_VECTORS = "SELECT query_id, e.embedding FROM (SELECT DISTINCT id AS query_id FROM query_audit WHERE id % 20 = 0) JOIN embeddings e ON vec_id = query_id % (SELECT count(*) FROM embeddings)"
_FUSED = (
    "WITH " + _bm25(True, True) + ",\n"
    + "lex AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), doc_id) AS bm25_rk FROM found) WHERE bm25_rk <= 50),\n"
    + _knn(_HYBRID_VECTORS, 50)
    + """, fused AS (SELECT coalesce(lex.query_id, near.query_id) AS query_id, coalesce(lex.doc_id, near.doc_id) AS doc_id, bm25_rk, knn_rk,
  coalesce(1.0::DOUBLE / (60 + bm25_rk), 0) + coalesce(1.0::DOUBLE / (60 + knn_rk), 0) AS score FROM lex FULL JOIN near ON lex.query_id = near.query_id AND lex.doc_id = near.doc_id)
"""
)


def _ranked(keep: str) -> str:
    return (
        _FUSED
        + f""", placed AS (SELECT f.*, coalesce(d.project, '') AS project FROM fused f JOIN documents d USING (doc_id) {keep}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY score DESC, coalesce(bm25_rk, 1 << 30), coalesce(knn_rk, 1 << 30), doc_id) AS b FROM placed) WHERE b = 1)
SELECT query_id, project, doc_id, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS place FROM best) WHERE place <= 10"""
    )


_JUDGED = (
    "WITH " + _bm25(False, False, "(SELECT * FROM documents WHERE session_id IS NOT NULL)")
    + """, ritem AS (SELECT query_id, session_id AS item, min(round(rank, 6)) AS rank FROM found JOIN documents USING (doc_id) GROUP BY 1, 2),
ret AS (SELECT * FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank, item) AS rk FROM ritem) WHERE rk <= 50),
rel AS (SELECT DISTINCT id AS query_id, top_session_id AS item FROM query_audit WHERE id % 20 = 0 AND top_session_id IS NOT NULL),
q AS (SELECT rel.query_id, CASE WHEN coalesce(min(rk), 11) <= 10 THEN 1 ELSE 0 END AS found, coalesce(sum(CASE WHEN rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END), 0)
  / list_sum(list_transform(range(1, 1 + least(count(*), 10)), lambda i: 1 / log2(i + 1))) AS ndcg FROM rel LEFT JOIN ret ON rel.query_id = ret.query_id AND rel.item = ret.item GROUP BY 1)
"""
)

_VERSIONS = """WITH s AS (SELECT *, coalesce(try_cast('0x' || substring(id, 1, 6) AS BIGINT), 0) AS no FROM sessions),
fresh AS (SELECT id, path, project, date, title || ' (again)' AS title, CASE WHEN no % 3 = 0 THEN reverse(hash) ELSE hash END AS hash, indexed_at + 1 AS indexed_at FROM s WHERE no % 7 <> 0),
stored AS (SELECT * FROM s WHERE no % 7 = 0 OR no % 5 <> 0)
"""
_SUMMARY = """concat_ws(chr(10), CASE WHEN summary <> '' THEN summary END, CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END,
CASE WHEN len(entities) > 0 THEN 'Entities: ' || array_to_string(entities, ', ') END, CASE WHEN len(learnings) > 0 THEN 'Learnings: ' || array_to_string(learnings, ' ') END,
CASE WHEN len(questions) > 0 THEN 'Questions: ' || array_to_string(questions, ' ') END)"""
_BACKFILL = "SELECT * FROM sessions WHERE enriched_at IS NOT NULL AND summary <> '' AND id NOT IN (SELECT session_id FROM chunks WHERE seq = -1)"
_CAL = "SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(min(try_cast(date AS DATE)), max(try_cast(date AS DATE)), INTERVAL 1 DAY)) AS d FROM sessions WHERE date <> '')"
_DAY_N = "SELECT date, CAST(count(*) AS DOUBLE) AS value FROM sessions WHERE date <> '' GROUP BY 1"
_DAY_H = "SELECT date, round(sum(coalesce(duration_seconds, 0)) / 3600, 1) AS value FROM sessions WHERE date <> '' GROUP BY 1"
_FIELD = "CASE tool " + " ".join(f"WHEN '{t}' THEN CASE WHEN json_type(b->'$.input', '$.{k}') = 'VARCHAR' THEN b->'$.input'->>'$.{k}' END" for t, k in TOOL_FIELD.items()) + " END"
_LASTS = "SELECT event_type, date_trunc('{0}', ts) AS bucket, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1, 2"
_RUNS = """WITH e AS (SELECT user_id AS log, event_id AS no, ts, event_type AS t FROM events),
i AS (SELECT *, sum(CASE WHEN t IN ('view', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY ts, no ROWS UNBOUNDED PRECEDING) AS run FROM e WHERE t IN ('view', 'signup', 'purchase', 'click')),
i1 AS (SELECT *, coalesce(sum(CASE WHEN t = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY log, run ORDER BY ts, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM i),
ig AS (SELECT log, run, min(no) FILTER (t = 'view') AS start_no, count(*) FILTER (t = 'click' AND done = 0) AS n_items,
  min((ts, no)) FILTER (t = 'purchase' AND done = 0) AS d, bool_or(t = 'purchase' AND done = 0) AS complete FROM i1 GROUP BY 1, 2 HAVING bool_or(t = 'view')),
ib AS (SELECT log, run, lead(t) OVER (PARTITION BY log ORDER BY run) AS closer, lead((ts, no)) OVER (PARTITION BY log ORDER BY run) AS closer_at FROM i1 WHERE t IN ('view', 'signup')),
eb AS (SELECT log, no, t, lead(t) OVER (PARTITION BY log ORDER BY ts, no) AS closer, lead((ts, no)) OVER (PARTITION BY log ORDER BY ts, no) AS closer_at FROM e WHERE t IN ('error', 'signup')),
g AS (SELECT ig.log, 'index' AS kind, start_no, complete, NOT complete AND coalesce(closer, '') <> 'signup' AS running, n_items, coalesce(d, closer_at) AS closed FROM ig JOIN ib USING (log, run)
  UNION ALL SELECT log, 'enrich', no, false, coalesce(closer, '') <> 'signup', 0, closer_at FROM eb WHERE t = 'error')
"""

_TOOLS = (
    f""", u AS (SELECT line_id, position, block->>'$.name' AS tool, block AS b FROM blocks WHERE depth = 0 AND block_type = 'tool_use' AND json_type(block, '$.name') = 'VARCHAR' AND block->>'$.name' <> ''),
f AS (SELECT line_id, position, tool, coalesce({_FIELD}, CAST(b->'$.input' AS VARCHAR), '{{}}') AS raw FROM u),
calls AS (SELECT session_id, line_no, position + 1 AS part_no, tool || ': `' || CASE WHEN length(raw) > 80 THEN substring(raw, 1, 80) || '…' ELSE raw END || '`' AS summary
  FROM f JOIN talk USING (line_id) WHERE talk."type" = 'assistant' AND talk.role = 'assistant')
"""
)


def _after(recursive: str, plain: str) -> str:
    """CTEs of a recursive text followed by those of a plain one."""
    return recursive.rstrip() + ",\n" + plain.removeprefix("WITH ")


_GRAMMAR = (
    "WITH " + _bm25(True, True)
    + f""", g0 AS (SELECT query_id, length(query) % 4 AS how, {_CLEAN} AS q FROM asked),
g1 AS (SELECT query_id, how, string_split(q, ' ') AS ws FROM g0 WHERE q <> '' AND how < 3 AND NOT regexp_matches(q, '[''-]')),
g2 AS (SELECT query_id, how, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM g1),
g3 AS (SELECT query_id, how, how < 2 OR i = 1 AS wanted, translate(lower(w), '{ACCENTED}', '{PLAIN}') AS term FROM g2),
g4 AS (SELECT query_id, how, wanted, term, count(*) AS qtf FROM g3 GROUP BY ALL),
g5 AS (SELECT *, count(*) FILTER (wanted) OVER (PARTITION BY query_id) AS n_wanted FROM g4),
ghit AS (SELECT g5.query_id, how, n_wanted, post.doc_id, wanted, qtf * (CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END)
  * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl)) AS s FROM g5 JOIN post USING (term) JOIN df USING (term) CROSS JOIN st),
gfound AS (SELECT query_id, doc_id, -sum(s) FILTER (wanted) AS rank FROM ghit GROUP BY query_id, doc_id, how, n_wanted HAVING count(*) FILTER (NOT wanted) = 0 AND (how = 1 OR count(*) = n_wanted))
"""
)
_FEED = (
    _RUNS
    + """, top AS (SELECT max(ts) AS now FROM events),
s0 AS (SELECT g.log, g.kind, g.start_no, g.n_items, g.closed, g.running AND NOT CASE g.kind WHEN 'enrich' THEN epoch_ms(now) - epoch_ms(e.ts) > 30000 ELSE epoch_ms(now) - epoch_ms(e.ts) > 600000 END AS running
  FROM g JOIN e ON e.no = g.start_no, top),
m AS (SELECT *, kind = 'index' AND NOT running AND n_items = 0 AS idle, row_number() OVER (PARTITION BY log ORDER BY closed ASC NULLS LAST, kind DESC, start_no) AS no FROM s0),
x AS (SELECT *, CASE WHEN idle THEN no - row_number() OVER (PARTITION BY log, idle ORDER BY no) ELSE -no END AS island FROM m),
o AS (SELECT log, min(no) AS no, arg_min(kind, no) AS kind, arg_min(running, no) AS running, count(*) AS n_runs, CAST(sum(n_items) AS BIGINT) AS n_items FROM x GROUP BY log, idle, island),
m2 AS (SELECT *, kind = 'enrich' AND NOT running AND n_items = 0 AS idle, row_number() OVER (PARTITION BY log ORDER BY no) AS place FROM o),
x2 AS (SELECT *, CASE WHEN idle THEN place - row_number() OVER (PARTITION BY log, idle ORDER BY place) ELSE -place END AS island FROM m2),
f AS (SELECT log, min(no) AS no, arg_min(kind, no) AS kind, arg_min(running, no) AS running, CAST(sum(n_runs) AS BIGINT) AS n_runs, CAST(sum(n_items) AS BIGINT) AS n_items FROM x2 GROUP BY log, idle, island)
SELECT log, no, kind, n_runs, n_items, running, CASE kind WHEN 'index' THEN CASE WHEN running THEN 'Indexing…' ELSE 'Index scan' END ELSE CASE WHEN running THEN 'Enriching…' ELSE 'Enrich run' END END AS label,
CASE WHEN n_runs > 1 THEN n_runs || CASE kind WHEN 'index' THEN '× no new sessions' ELSE '× nothing to enrich' END
 WHEN running THEN CASE kind WHEN 'index' THEN CASE WHEN n_items > 0 THEN n_items || ' indexed' END ELSE n_items || ' / ?' END
 ELSE n_items || CASE kind WHEN 'index' THEN ' new' ELSE '' END || ' session' || CASE WHEN n_items = 1 THEN '' ELSE 's' END || CASE kind WHEN 'index' THEN '' ELSE ' enriched' END END AS detail FROM f"""
)

SQL = {
    "index_refresh": "WITH " + _bm25(True, True) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1",
    "search_grammar": _GRAMMAR + _TEN.format("gfound"),
    "session_documents": _after(_BLOCKS, _LINES) + _TOOLS
    + """SELECT session_id, line_no, 0 AS part_no, md5('[' || upper(role[1]) || role[2:] || '] ' || txt) AS line_md5 FROM t UNION ALL SELECT session_id, line_no, part_no, md5('[Tool] ' || summary) FROM calls""",
    "session_pages": _after(_BLOCKS, _HEADS) + _TOOLS
    + """, pages AS (SELECT session_id, line_no, 0 AS part_no, '## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || txt || chr(10) AS line FROM t
UNION ALL SELECT session_id, line_no, part_no, '> **Tool:** ' || summary FROM calls
UNION ALL SELECT session_id, -1, 0, '# Session: ' || project || ' — ' || date || chr(10) || coalesce(chr(10) || '_' || title || '_' || chr(10), '') FROM h)
SELECT session_id, line_no, part_no, md5(line) AS line_md5 FROM pages
UNION ALL SELECT id, -2, 0, md5(regexp_replace('## Summary' || chr(10) || chr(10) || summary || chr(10) || chr(10) || ls || CASE WHEN ls <> '' THEN chr(10) ELSE '' END || '---' || chr(10), '\\n{3,}', chr(10) || chr(10), 'g'))
FROM (SELECT id, summary, CASE WHEN len(tags) > 0 THEN '**Tags:** ' || array_to_string(tags, ', ') || chr(10) ELSE '' END
 || CASE WHEN len(entities) > 0 THEN '**Entities:** ' || array_to_string(entities, ', ') || chr(10) ELSE '' END AS ls FROM sessions WHERE summary <> '') WHERE id IN (SELECT session_id FROM pages)""",
    "hybrid_sessions": _FUSED
    + """, placed AS (SELECT f.*, d.session_id FROM fused f JOIN documents d USING (doc_id) WHERE d.session_id IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY score DESC, coalesce(bm25_rk, 1 << 30), coalesce(knn_rk, 1 << 30), doc_id) AS b FROM placed) WHERE b = 1),
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS place FROM best) WHERE place <= 10)
SELECT query_id, session_id, doc_id, round(score, 9) AS score, place, s.project, s.date, s.title, md5(CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE coalesce(text, '') END) AS preview_md5
FROM ten JOIN sessions s ON s.id = session_id JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)""",
    "query_cache": "SELECT id AS query_id, length(query) % 2 = 0 AS hit, 64 AS dims FROM (SELECT id, min(query) AS query FROM query_audit GROUP BY id) WHERE query IS NOT NULL",
    "summary_vectors": "SELECT DISTINCT id, regexp_replace(id, '_[^_]*$', '') AS session_id, 64 AS dims FROM chunks WHERE seq = -1 AND text IS NOT NULL AND session_id IS NOT NULL",
    "heatmap_project": """WITH s AS (SELECT * FROM sessions WHERE date <> '' AND project = (SELECT min(project) FROM sessions WHERE project <> '')),
c AS (SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(min(try_cast(date AS DATE)), max(try_cast(date AS DATE)), INTERVAL 1 DAY)) AS d FROM s))
SELECT date, coalesce(value, 0) AS value FROM c LEFT JOIN (SELECT date, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY 1) USING (date)""",
    "eval_indexed": _JUDGED
    + "SELECT count(*) AS queries, round(avg(found), 4) AS found_at_k, round(avg(ndcg), 4) AS ndcg_at_k FROM q WHERE query_id IN (SELECT query_id FROM rel WHERE item IN (SELECT session_id FROM documents WHERE session_id IS NOT NULL))",
    "finished_sessions": """SELECT id, 1770200000000 AS enriched_at, 3 AS enrichment_version FROM sessions WHERE (enriched_at IS NULL OR coalesce(enrichment_version < 3, true))
AND NOT EXISTS (SELECT 1 FROM chunks WHERE seq >= 0 AND session_id = sessions.id)""",
    "json_paths": """WITH j AS (SELECT line_id, CAST(raw AS JSON) AS j FROM raw_lines WHERE json_valid(raw)), c AS (SELECT line_id, j, CASE WHEN json_type(j, '$.message.content') = 'ARRAY' THEN j->'$.message.content' END AS c FROM j)
SELECT line_id, c->>'$[0].type' AS first_type, (list_filter(from_json(c, '["JSON"]'), lambda x: json_type(x) = 'OBJECT' AND x->>'$.type' = 'tool_result')[1])->>'$.tool_use_id' AS result_id,
coalesce(CASE WHEN json_type(j, '$.message') = 'OBJECT' THEN j->>'$.message.role' END, 'none') AS role FROM c""",
    "reply_parse": r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '<think>[\s\S]*?</think>', '', 'g')) AS clean FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, regexp_extract(clean, '(\{[\s\S]*\})', 1) AS span FROM c), v AS (SELECT *, CASE WHEN json_valid(span) THEN CAST(span AS JSON) END AS v FROM s)
SELECT doc_id, coalesce(v->>'$.title', '') AS title, md5(CASE WHEN span = '' THEN substring(clean, 1, 500) ELSE coalesce(v->>'$.summary', '') END) AS summary_md5,
CAST(CASE WHEN json_type(v, '$.tags') = 'ARRAY' THEN len(list_filter(CAST(v->'$.tags' AS JSON[]), lambda x: json_type(x) <> 'NULL')) ELSE 0 END AS INTEGER) AS n_tags FROM v""",
    "regex_values": r"""SELECT doc_id, try_cast(CASE WHEN regexp_matches(text, '(?s)([0-9]{1,6})\s+([a-z]+)') THEN regexp_extract(text, '(?s)([0-9]{1,6})\s+([a-z]+)', 1) END AS BIGINT) AS n,
CASE WHEN regexp_matches(text, '(?s)([0-9]{1,6})\s+([a-z]+)') THEN regexp_extract(text, '(?s)([0-9]{1,6})\s+([a-z]+)', 2) END AS unit FROM documents WHERE text IS NOT NULL""",
    "activity_feed": _FEED,
    "turn_filter": _LINES + "SELECT session_id, line_no, role, md5(txt) AS text_md5 FROM t",
    "session_headers": _HEADS + "SELECT * FROM h",
    "indexable_sessions": _HEADS + "SELECT session_id, n_user FROM h WHERE n_user >= 2",
    "session_text": _LINES + "SELECT session_id, line_no, md5('[' || upper(role[1]) || role[2:] || '] ' || txt) AS line_md5 FROM t",
    "render_markdown": _LINES + "SELECT session_id, line_no, md5('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || txt || chr(10)) AS line_md5 FROM t",
    "strip_markup": f"SELECT doc_id, md5({_MARKUP.format('text')}) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "tool_summary": _BLOCKS
    + f""", u AS (SELECT line_id, block_path, block->>'$.name' AS tool, block AS b FROM blocks WHERE block_type = 'tool_use' AND json_type(block, '$.name') = 'VARCHAR'),
f AS (SELECT line_id, block_path, tool, coalesce({_FIELD}, CAST(b->'$.input' AS VARCHAR), '{{}}') AS raw FROM u)
SELECT line_id, block_path, tool || ': `' || CASE WHEN length(raw) > 80 THEN substring(raw, 1, 80) || '…' ELSE raw END || '`' AS summary FROM f""",
    "preview": "SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE text END AS preview FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "chunk_sessions": "SELECT regexp_replace(id, '_[^_]*$', '') AS session_id, count(DISTINCT id) AS n_chunks FROM chunks GROUP BY 1",
    "active_duration": """WITH g AS (SELECT user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL)
SELECT user_id, CAST(round(coalesce(sum(CASE WHEN gap > 900000 THEN 900000 ELSE gap END), 0) / 1000) AS BIGINT) AS duration_seconds FROM g GROUP BY 1""",
    "term_stats": "WITH " + _bm25(True, True) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1",
    "corpus_stats": "WITH " + _bm25(True, True) + "SELECT n_docs, round(avgdl, 6) AS avgdl FROM st",
    "bm25_all": "WITH " + _bm25(True, True) + _TEN.format("found"),
    "bm25_any": "WITH " + _bm25(False, False) + _TEN.format("found"),
    "bm25_not": "WITH " + _bm25(True, True) + ", left_over AS (SELECT * FROM found WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'index'))\n" + _TEN.format("left_over"),
    "knn_cosine": "WITH " + _knn("SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0", 10) + "SELECT query_id, doc_id AS id, round(distance, 6) + 0.0 AS distance FROM near",
    "rrf_fusion": _FUSED + "SELECT query_id, doc_id, bm25_rk, knn_rk, round(score, 9) AS score FROM fused",
    "hybrid_search": _ranked(""),
    "hybrid_filtered": _ranked("WHERE lower(regexp_replace(d.lang, '^\\s+|\\s+$', '', 'g')) = 'en' AND d.created_at >= TIMESTAMPTZ '2026-01-15 00:00:00+00'"),
    "browse_page": "SELECT id, project, date, title FROM sessions ORDER BY coalesce(last_message_at, indexed_at) DESC, id LIMIT 100 OFFSET 20",
    "browse_total": "SELECT count(*) AS n FROM sessions WHERE date >= '2026-01-10' AND date <= '2026-01-31' AND lower(project) LIKE '%e%'",
    "filter_tag": "SELECT id FROM sessions WHERE len(list_filter(tags, lambda t: lower(t) LIKE '%session%')) > 0",
    "filter_project": "SELECT id, project FROM sessions WHERE lower(project) LIKE '%ral%'",
    "filter_date": "SELECT id, date FROM sessions WHERE date = '2026-01-12'",
    "status_counts": "SELECT count(*) AS sessions, max(indexed_at) AS last_indexed_at, count(enriched_at) AS enriched, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM query_audit) AS searches, count(*) - count(enriched_at) AS pending FROM sessions",
    "projects_recent": "SELECT project, max(date) AS last_date, count(*) AS n FROM sessions WHERE project <> '' GROUP BY 1",
    "heatmap_sessions": f"SELECT date, coalesce(value, 0) AS value FROM ({_CAL}) LEFT JOIN ({_DAY_N}) USING (date)",
    "heatmap_hours": f"SELECT date, coalesce(value, 0) AS value FROM ({_CAL}) LEFT JOIN ({_DAY_H}) USING (date)",
    "heatmap_intensity": f"""WITH v AS (SELECT date, coalesce(value, 0) AS value FROM ({_CAL}) LEFT JOIN ({_DAY_N}) USING (date)), m AS (SELECT max(value) AS top FROM v)
SELECT date, value, CASE WHEN value <= 0 THEN 0 WHEN value / top <= 0.25 THEN 1 WHEN value / top <= 0.5 THEN 2 WHEN value / top <= 0.75 THEN 3 ELSE 4 END AS level FROM v, m""",
    "heatmap_totals": f"SELECT round(sum(value), 1) AS total, count(*) FILTER (value > 0) AS active_days FROM ({_DAY_H})",
    "heatmap_by_project": "SELECT date, project, count(*) AS n FROM sessions WHERE date <> '' GROUP BY 1, 2",
    "heatmap_weekly": """WITH w AS (SELECT strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS week, project, count(*) AS n FROM sessions WHERE date <> '' GROUP BY 1, 2)
SELECT week, project, n, CAST(sum(n) OVER (PARTITION BY week) AS BIGINT) AS week_total, CAST(greatest(ceil(sum(n) OVER (PARTITION BY week) / 5) * 5, 5) AS BIGINT) AS axis_max FROM w""",
    "distinct_tags": "SELECT DISTINCT item FROM (SELECT unnest(tags) AS item FROM sessions) WHERE trim(item) <> ''",
    "upsert_merge": _VERSIONS
    + """SELECT coalesce(f.id, s.id) AS id, CASE WHEN f.id IS NULL THEN s.title WHEN s.hash = f.hash THEN coalesce(s.title, f.title) ELSE f.title END AS title,
CASE WHEN f.id IS NULL THEN s.hash ELSE f.hash END AS hash, CASE WHEN f.id IS NULL THEN s.indexed_at ELSE f.indexed_at END AS indexed_at,
CASE WHEN f.id IS NULL OR s.hash = f.hash THEN s.summary END AS summary, CASE WHEN f.id IS NULL OR s.hash = f.hash THEN coalesce(len(s.tags), 0) ELSE 0 END AS n_tags,
CASE WHEN f.id IS NULL OR s.hash = f.hash THEN s.enriched_at END AS enriched_at, CASE WHEN f.id IS NULL OR s.hash = f.hash THEN s.enrichment_version END AS enrichment_version
FROM stored s FULL JOIN fresh f ON s.id = f.id""",
    "hash_changed": _VERSIONS + "SELECT id, hash FROM fresh WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.id = fresh.id AND s.hash IS NOT DISTINCT FROM fresh.hash)",
    "chunk_replace": f"""WITH f AS (SELECT id || '_summary' AS id, id AS session_id, -1 AS seq, md5({_SUMMARY}) AS text_md5 FROM ({_BACKFILL}))
SELECT DISTINCT id, session_id, seq, md5(text) AS text_md5 FROM chunks WHERE session_id NOT IN (SELECT session_id FROM f) UNION ALL SELECT * FROM f""",
    "backfill_anti": f"SELECT id FROM ({_BACKFILL})",
    "summary_chunk": f"SELECT id || '_summary' AS id, id AS session_id, -1 AS seq, md5({_SUMMARY}) AS text_md5 FROM sessions",
    "pending_enrich": "SELECT id FROM sessions WHERE (enriched_at IS NULL OR coalesce(enrichment_version < 3, true)) AND coalesce(last_message_at, indexed_at) < 1769500000000",
    "digest_cut": r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '[Tool]')) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l),
r AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) + i - 1 AS upto FROM e),
b AS (SELECT doc_id, coalesce(min(i) FILTER (upto > 6000) - 1, max(i)) AS kept, bool_or(upto > 6000) AS cut FROM r GROUP BY 1)
SELECT l.doc_id, CAST(coalesce(kept, 0) AS INTEGER) AS kept, coalesce(cut, false) AS cut,
md5(array_to_string(list_concat(ls[1:coalesce(kept, 0)], CASE WHEN cut THEN ['... (truncated)'] ELSE [] END), chr(10))) AS digest_md5 FROM l LEFT JOIN b USING (doc_id)""",
    "dedupe_last_wins": "SELECT session_id, line_no, line_id, type FROM (SELECT *, row_number() OVER (PARTITION BY session_id, line_no ORDER BY line_id DESC) AS n FROM messages) WHERE n = 1",
    "live_over_archive": _VERSIONS + "SELECT id, title FROM fresh UNION ALL SELECT id, title FROM stored WHERE id NOT IN (SELECT id FROM fresh)",
    "project_cap_sample": """SELECT id, project FROM (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY md5(id || '|1'), id) AS n FROM sessions)
WHERE n <= greatest(3, 100 // (SELECT count(*) FROM (SELECT DISTINCT project FROM sessions))) ORDER BY md5(id || '|1'), id LIMIT 100""",
    "activity_groups": _RUNS + "SELECT log, kind, start_no, complete, running, n_items FROM g",
    "activity_collapsed": _RUNS
    + """, m AS (SELECT *, kind = 'index' AND NOT running AND n_items = 0 AS empty, row_number() OVER (PARTITION BY log ORDER BY closed ASC NULLS LAST, kind DESC, start_no) AS no FROM g),
x AS (SELECT *, CASE WHEN empty THEN no - row_number() OVER (PARTITION BY log, empty ORDER BY no) ELSE -no END AS island FROM m)
SELECT log, min(no) AS first_no, count(*) AS n_runs, CAST(sum(n_items) AS BIGINT) AS n_items, empty AND count(*) > 1 AS collapsed FROM x GROUP BY log, empty, island""",
    "metric_last_per_bucket": _LASTS.format("day"),
    "metric_delta": f"SELECT event_type, bucket, value, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY bucket), 6) AS delta FROM ({_LASTS.format('day')})",
    "metric_changes": f"SELECT event_type, bucket, round(delta, 6) AS delta FROM (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY bucket) AS delta FROM ({_LASTS.format('week')})) WHERE abs(delta) >= 5 AND delta > 0",
    "jsonpath_extract": "SELECT event_id, round(CAST(props->>'$.k' AS DOUBLE) / 100, 2) AS value, CASE WHEN round(CAST(props->>'$.k' AS DOUBLE) / 100, 2) BETWEEN 0.1 AND 0.9 THEN 'ok' ELSE 'error' END AS status FROM events",
    "eval_found_ndcg": _JUDGED + "SELECT query_id, found, round(ndcg, 6) AS ndcg FROM q",
    "eval_summary": _JUDGED + "SELECT count(*) AS queries, round(avg(found), 4) AS found_at_k, round(avg(ndcg), 4) AS ndcg_at_k FROM q",
    "eval_diagnosis": _JUDGED
    + """, n AS (SELECT session_id AS item, count(*) AS n_chunks FROM documents WHERE session_id IS NOT NULL GROUP BY 1),
j AS (SELECT rel.query_id, rel.item, ret.rk, w.item AS winner, row_number() OVER (PARTITION BY rel.query_id ORDER BY ret.rk NULLS LAST, rel.item) AS no FROM rel
  LEFT JOIN ret ON ret.query_id = rel.query_id AND ret.item = rel.item LEFT JOIN ret w ON w.query_id = rel.query_id AND w.rk = 1)
SELECT CASE WHEN rk <= 10 THEN 'OK' WHEN rk IS NULL THEN 'NOT_RETRIEVED' WHEN wn.n_chunks >= 2 * coalesce(n.n_chunks, 0) THEN 'COMPETING_SESSIONS' ELSE 'RANKED_LOW' END AS diagnosis, count(*) AS n
FROM j LEFT JOIN n ON n.item = j.item LEFT JOIN n wn ON wn.item = j.winner WHERE no = 1 GROUP BY 1""",
    "eval_percentiles": """WITH o AS (SELECT id, min(duration_ms) AS ms, min(k) AS k FROM query_audit WHERE duration_ms >= 0 AND NOT isnan(duration_ms) GROUP BY id)
SELECT k, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM o GROUP BY k""",
    "audit_recent": "SELECT id, min(CASE WHEN abs(created_at) < 100000000000 THEN created_at * 1000 ELSE created_at END) AS at, min(query) AS query FROM query_audit GROUP BY id ORDER BY 2 DESC, id LIMIT 100",
    "stream_tumbling": "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessionize": """WITH c AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 900000000 THEN 0 ELSE 1 END AS cut FROM events),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM c) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r GROUP BY user_id, no""",
    **GATEWAY,
}
