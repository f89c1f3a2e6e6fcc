"""DuckDB SQL for the queries of ``parlance.agent_queries``."""

from parlance.oracles import _E, _IN, _M, _P, _collapse, _fresh, _hits, _rank

_EV = "e AS MATERIALIZED (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_S = r"""s AS MATERIALIZED (SELECT doc_id, lang, CASE WHEN doc_id % 7 <> 0 THEN '/w/repo' || CASE doc_id % 3 WHEN 0 THEN '/sub' WHEN 1 THEN '-else' ELSE '' END END AS cwd,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN upper(u) ELSE u END ELSE 'ses_' || doc_id END AS session_id,
  CASE WHEN doc_id % 5 <> 0 THEN 'p' || (doc_id % 4) || CASE WHEN doc_id % 3 = 0 THEN '/tree' ELSE '' END END AS project
  FROM (SELECT *, regexp_replace(md5(CAST(doc_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS u FROM documents))"""
_W = r"""w AS MATERIALIZED (SELECT doc_id, text, w[1] AS a, w[2] AS b, w[3] AS c FROM (SELECT doc_id, text, string_split_regex(trim(regexp_replace(left(text, 400), '[^\p{L}\n ]', '', 'g')), '[\n ]+') AS w FROM documents))"""
_UUID = "cfcd2084-95d5-65ef-66e7-dff9f98764da"
_BOX = "[─━│┃┌┐└┘├┤┬┴┼╭╮╰╯═║╔╗╚╝]"
_RANGES = "r AS MATERIALIZED (SELECT conv_id, (ordinal - 1) // 4 AS chunk, min(ordinal) AS first, max(ordinal) AS last, string_agg(text, ' ' ORDER BY ordinal) AS text FROM m GROUP BY 1, 2)"
_SCORED = f"""{_RANGES}, {_E.replace("e AS MATERIALIZED", "v AS MATERIALIZED", 1)}, x AS MATERIALIZED (SELECT r.*, score, ((contains(lower(text), 'the'))::INT + (contains(lower(text), 'of'))::INT) / 2.0::DOUBLE AS word_match FROM r JOIN v ON vec_id = conv_id * 3 + chunk),
y AS MATERIALIZED (SELECT *, score + 0.2 * word_match AS hybrid FROM x)"""


def _is_artifact(t: str) -> str:
    count = lambda p: f"(len({t}) - len(regexp_replace({t}, '{p}', '', 'g')))"
    chars, boxes, marks, letters = rf"len(regexp_replace({t}, '\s', '', 'g'))", count(_BOX), count(r"[|\-+=_`]"), count(r"[\p{L}\p{N}]")
    code = " OR ".join(f"contains({t}, '{c}')" for c in ("::{", "=>", "</", "<div", "function ", "const ", "let ", "fn "))
    return f"({chars} = 0 OR {boxes} * 4 >= {chars} OR ({boxes} >= 3 AND {chars} <= 24) OR ({marks} * 2 > {letters} AND contains({t}, '|')) OR ({marks} > {letters} // 4 AND ({code})))"


def _turn() -> str:
    out = r"regexp_replace(text, '(?s)```.*?(?:```|\z)', '', 'g')"
    tags = ("system-reminder", "local-command-caveat", "local-command-stdout", "local-command-stderr", "command-message", "command-name")
    for tag in tags:
        out = rf"regexp_replace({out}, '(?s)<{tag}>.*?(?:</{tag}>|\z)', '', 'g')"
    held = " OR ".join(f"contains(x, '<{t}>') OR contains(x, '</{t}>')" for t in tags)
    said = " OR ".join(f"contains(lower(x), '{t}')" for t in ("validation passed", "all checks pass", "working tree clean", "committed", "commit:", "validation:"))
    ran = " OR ".join(f"contains(lower(x), '{t}')" for t in ("cargo test", "just check", "git status", "git diff"))
    blocks = f"list_transform(regexp_extract_all({_collapse(out)}, '{_BOX}+|[^{_BOX[1:-1]}]+'), lambda x: trim(x))"
    return f"nullif({_collapse(f'''array_to_string(list_filter({blocks}, lambda x: x <> '' AND NOT starts_with(x, '/') AND NOT ({held}) AND NOT (role = 'assistant' AND ({said}) AND ({ran})) AND NOT {_is_artifact('x')}), ' ')''')}, '')"


_TURN = _turn()
_JSON = "'{{' || array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',') || '}}'"

SQL = {
    "total_tokens": f"""WITH {_EV}, u AS (SELECT user_id AS conv_id, CASE WHEN event_type = 'click' THEN 'a' ELSE '' END AS thread, CASE WHEN event_id % 4 <> 0 THEN 'r' || (event_id // 3) END AS reply, event_id,
  coalesce(k, 0) + event_id % 7 + CASE WHEN event_id % 5 <> 0 THEN event_id % 11 ELSE 0 END + 1 AS n FROM e),
p AS (SELECT conv_id, max_by(n, event_id) AS n FROM u WHERE reply IS NOT NULL GROUP BY conv_id, thread, reply UNION ALL SELECT conv_id, n FROM u WHERE reply IS NULL) SELECT conv_id, CAST(sum(n) AS BIGINT) AS total_tokens FROM p GROUP BY 1""",
    "usage_split": f"""WITH {_EV}, u AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN k END AS t, CASE WHEN event_id % 9 <> 0 AND k IS NOT NULL THEN event_id % 50 ELSE 0 END AS c, CASE WHEN event_id % 9 <> 0 THEN event_id % 3 ELSE 0 END AS o FROM e),
x AS (SELECT event_id, greatest(coalesce(t, 0) - c, 0) AS i, o, c FROM u) SELECT event_id % 10 AS part, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(0 AS BIGINT) AS cache_write, CAST(sum(c) AS BIGINT) AS cache_read, count(*) AS n FROM x WHERE i + o + c > 0 GROUP BY 1""",
    "session_titles": f"""WITH {_EV}, t AS (SELECT user_id * 10 + event_id % 10 AS conv_id, event_id, CASE event_id % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'a' WHEN 2 THEN 's' ELSE 'x' END AS kind, event_id % 3 = 0 AS ahead, CASE WHEN k % 6 = 0 THEN '  ' ELSE ' t' || k END AS text FROM e WHERE event_id % 41 < 9),
g AS (SELECT conv_id, count(*) FILTER (kind = 'c' AND NOT ahead) AS own, max_by(text, event_id) FILTER (kind = 'c' AND NOT ahead) AS a, max_by(text, event_id) FILTER (kind = 'c' AND ahead) AS b,
  max_by(trim(text), event_id) FILTER (kind = 'a' AND NOT ahead AND trim(text) <> '') AS c, max_by(trim(text), event_id) FILTER (kind = 'a' AND ahead AND trim(text) <> '') AS d, min_by(text, event_id) FILTER (kind = 's') AS f FROM t GROUP BY 1)
SELECT conv_id, nullif(trim(CASE WHEN own > 0 THEN a ELSE b END), '') AS custom_title, coalesce(c, d, f) AS summary FROM g""",
    "session_models": f"""WITH {_EV}, t AS (SELECT user_id AS conv_id, event_id, event_type = 'error' AND user_id % 3 = 0 AS change, CASE WHEN k % 4 <> 0 THEN 'm' || (k % 5) END AS model FROM e)
SELECT conv_id, coalesce(max_by(model, event_id) FILTER (change AND model IS NOT NULL), min_by(model, event_id) FILTER (NOT change AND model IS NOT NULL)) AS model FROM t GROUP BY 1""",
    "activity_span": f"""WITH {_EV}, t AS (SELECT user_id AS conv_id, event_id, event_id * 31 % 997 AS s, event_id % 8 <> 0 AND event_id % 3 < 2 AS ok FROM e)
SELECT conv_id, min_by(s, event_id) FILTER (ok) AS first_second, max_by(s, event_id) FILTER (ok) AS last_second, max(s) FILTER (ok) AS latest_second FROM t GROUP BY 1""",
    "elapsed_times": f"WITH {_EV}, t AS (SELECT user_id, event_id, event_id * 37 % 101 - lag(event_id * 37 % 101) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM e) SELECT user_id, event_id, CASE WHEN x >= 0 THEN x END AS elapsed FROM t",
    "turn_durations": f"""WITH {_EV}, s AS (SELECT 'u' || user_id AS uuid, max_by(k, event_id) AS duration_ms FROM e WHERE event_type = 'error' AND event_id % 3 <> 0 AND k IS NOT NULL GROUP BY 1) SELECT uuid, duration_ms FROM (SELECT DISTINCT 'u' || (user_id + event_id % 2) AS uuid FROM e) LEFT JOIN s USING (uuid)""",
    "repeated_skills": f"""WITH {_EV}, t AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 's' || (k % 3) END AS skill, last_value(CASE WHEN event_type = 'click' THEN 's' || (k % 3) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM e)
SELECT user_id, event_id, coalesce(skill = c, false) AS repeated FROM t""",
    "entry_dispatch": f"""WITH {_EV}, t AS (SELECT ['text', 'tool_use', 'tool_result', 'thinking', 'meta', 'progress', 'summary', 'ai-title', 'custom-title', 'system'][k % 10 + 1] AS kind, event_id % 2 = 0 AS s, event_id % 3 > 0 AS n FROM e)
SELECT kind, CASE WHEN kind IN ('thinking', 'tool_use') THEN 'tools' WHEN kind IN ('summary', 'ai-title', 'custom-title') THEN 'titles' WHEN kind = 'meta' THEN CASE WHEN s THEN 'dialogue' ELSE 'nowhere' END WHEN kind = 'progress' THEN 'agent'
  WHEN kind IN ('text', 'tool_result') THEN CASE WHEN n THEN 'dialogue' ELSE 'outside' END ELSE 'nowhere' END AS goes, count(*) AS n FROM t GROUP BY 1, 2""",
    "workspace_filter": f"WITH {_S} SELECT doc_id, coalesce(cwd = '/w/repo' OR starts_with(cwd, '/w/repo/'), false) AS below, coalesce(cwd = '/w/repo', false) AS same FROM s",
    "excluded_projects": f"WITH {_S} SELECT doc_id, project FROM s WHERE project IS NULL OR project NOT IN ('p1', 'p2/tree', 'p1/tree')",
    "current_sessions": f"WITH {_S} SELECT doc_id FROM s WHERE session_id <> 'ses_3' AND lower(session_id) <> '{_UUID}'",
    "session_id_query": f"WITH {_S} SELECT doc_id, lower(session_id) AS id FROM s WHERE lower(session_id) = '{_UUID}'",
    "file_prune": f"WITH {_EV} SELECT user_id, CAST(sum(k) AS BIGINT) AS size FROM e GROUP BY 1 HAVING max(epoch_us(ts)) // 1000000 >= 1704500000",
    "listed_sessions": f"""WITH {_M}, x AS (SELECT conv_id, bool_or({_IN}) AS seen, CASE conv_id % 9 WHEN 0 THEN 'found-by-id' WHEN 1 THEN 'already-listed' ELSE 'discovered' END AS origin FROM m GROUP BY 1) SELECT conv_id, origin FROM x WHERE origin <> 'discovered' OR seen""",
    "unlisted_reasons": f"WITH {_EV} SELECT DISTINCT user_id AS conv_id, CASE WHEN user_id % 4 = 0 THEN 'no-conversation' WHEN user_id % 4 = 1 THEN 'clear-only' WHEN user_id % 4 = 2 THEN 'no-search-text' WHEN user_id % 8 = 7 THEN 'no-preview' END AS reason FROM e",
    "first_provider": "SELECT doc_id % 40 AS identity, min_by(doc_id, doc_id * 7 % 1009) AS doc_id FROM documents GROUP BY 1",
    "provider_union": f"WITH {_S} SELECT lang AS source, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS provider_order, count(*) AS n, CASE WHEN lang = 'de' THEN 0 ELSE count(project) END AS with_project FROM s WHERE lang IN ('en', 'de', 'fr') GROUP BY lang",
    "file_fingerprints": f"WITH {_EV} SELECT user_id AS session_id, CAST(sum(k) AS BIGINT) AS size, max(event_id) AS modified FROM e GROUP BY 1",
    "database_fingerprints": f"""WITH {_M}, g AS (SELECT conv_id, sum(strlen(text)) FILTER (conv_id % 4 > 0) + coalesce(sum(strlen(text)) FILTER (conv_id % 4 > 0 AND ordinal % 2 = 0), 0) AS size, max(ordinal) FILTER (conv_id % 4 > 0) AS up FROM m GROUP BY 1)
SELECT conv_id, CAST(coalesce(size, 0) AS BIGINT) AS size, greatest(CASE WHEN conv_id % 5 > 0 THEN conv_id END, up) AS modified FROM g""",
    "sidecar_titles": f"WITH {_S} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'new ' || doc_id ELSE 't' || doc_id END AS title, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 's' END AS summary FROM s",
    "dropped_records": f"WITH {_EV} SELECT user_id % 3 AS version, event_type AS kind, ['skipped', 'unrecognised', 'failed', 'read'][k % 4 + 1] AS outcome, count(*) AS n FROM e WHERE k % 4 < 3 GROUP BY ALL",
    "collapsed_warnings": f"WITH {_EV} SELECT event_type || '-' || (user_id % 40) AS kind, count(*) AS n, CASE WHEN count(DISTINCT user_id) = 1 THEN CAST(min(user_id) AS VARCHAR) END AS ref FROM e WHERE event_id < 200 GROUP BY 1",
    "catalogue_join": f"""WITH {_M}, {_P} SELECT 'p' || (p.conv_id % 3) AS project, CASE WHEN p.ordinal % 3 > 0 THEN m.role END AS role, p.conv_id % 2 = 0 AS located, count(*) AS parts, CAST(sum(len(p.text)) AS BIGINT) AS chars FROM parts p JOIN m USING (conv_id, ordinal) GROUP BY ALL""",
    "call_texts": f"""WITH {_W}, j AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN a END AS command, CASE WHEN doc_id % 2 = 0 THEN c END AS skill, CASE WHEN doc_id % 5 > 0 THEN b END AS pattern, concat_ws(chr(10), b, c) AS new FROM w),
k AS (SELECT *, 'name ' || {_JSON.format(", ".join(f"'\"{n}\":' || to_json({x})::VARCHAR" for n, x in (("command", "command"), ("file_path", "b"), ("old_string", "a"), ("new_string", "new"), ("skill", "skill"), ("args", "a"), ("url", "c"), ("prompt", "a"), ("pattern", "pattern"))))} AS raw FROM j)
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN coalesce(command, raw) WHEN 1 THEN CASE WHEN b IS NULL THEN raw ELSE regexp_replace(concat_ws(chr(10), b, concat_ws(chr(10), CASE WHEN a <> '' THEN '-' || a END, CASE WHEN b <> '' OR new <> '' THEN '+' || replace(new, chr(10), chr(10) || '+') END)), '\\n\\z', '') END
  WHEN 2 THEN CASE WHEN skill IS NULL THEN raw ELSE regexp_replace(concat_ws(chr(10), skill, a), '\\n\\z', '') END WHEN 3 THEN '.' WHEN 4 THEN CASE WHEN c IS NULL THEN raw ELSE regexp_replace(concat_ws(chr(10), c, a), '\\n\\z', '') END WHEN 5 THEN raw ELSE coalesce(pattern, raw) END AS text FROM k""",
    "result_texts": f"""WITH {_W} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN b ELSE concat_ws(chr(10), nullif(a, ''), CASE WHEN doc_id % 2 = 0 THEN '[image]' END, nullif(c, '')) END AS text FROM w""",
    "edit_diffs": f"""WITH {_W}, d AS (SELECT doc_id, regexp_replace(left(text, 300), '\\r?\\n\\z', '') AS o, left(text, 300) AS f, a, b FROM w)
SELECT doc_id, CASE WHEN a IS NULL OR b IS NULL THEN md5(CASE WHEN coalesce(f, '') = '' THEN '' ELSE '-' || regexp_replace(o, '\\r?\\n', chr(10) || '-', 'g') END) ELSE md5(concat_ws(chr(10), CASE WHEN coalesce(f, '') <> '' THEN '-' || regexp_replace(o, '\\r?\\n', chr(10) || '-', 'g') END, '+' || a || chr(10) || '+' || b)) END AS digest FROM d""",
    "task_reports": f"""WITH {_W}, k AS (SELECT *, doc_id % 5 > 0 AND doc_id % 7 > 0 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS ok FROM w) SELECT doc_id, CASE WHEN ok THEN trim(b) END AS summary, CASE WHEN ok THEN trim(c || '</result> ') END AS body, CASE WHEN ok AND doc_id % 2 = 0 THEN trim(a) END AS task_id, CASE WHEN ok THEN doc_id END AS tokens, NULL::BIGINT AS tool_calls FROM k""",
    "escaped_atoms": f"""WITH h AS (SELECT doc_id, text, regexp_extract_all(hex(encode(left(text, 200))), '..') AS p, {_collapse('text')} AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(chr(('0x' || x)::INT), '^[A-Za-z0-9._~:/+-]$') AND ('0x' || x)::INT < 128 THEN chr(('0x' || x)::INT) ELSE '%' || x END), '')) AS atom, md5(CASE WHEN len(t) <= 100 THEN t ELSE left(t, 97) || '...' END) AS snippet FROM h""",
    "evidence_previews": rf"WITH {_W} SELECT doc_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN {_collapse("a || ' ' || c || ' <b>bold</b>    < 3 ' || a")} END AS preview FROM w",
    "artifact_blocks": f"WITH {_W}, k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '|-- ' || a || ' | +=+ |' WHEN 1 THEN 'const ' || b || ' = `x`;' ELSE left(text, 60) END AS t FROM w) SELECT doc_id, {_is_artifact('t')} AS artifact FROM k",
    "semantic_turns": f"""WITH {_M}, n AS (SELECT conv_id, ordinal AS sequence, ordinal // 2 AS ordinal, role, text || CASE WHEN ordinal % 4 = 1 THEN chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '<system-reminder>x</system-reminder> ── tail' ELSE '' END AS text FROM m WHERE ordinal % 5 > 0),
t AS (SELECT conv_id, ordinal, sequence, {_TURN} AS turn FROM n), g AS (SELECT conv_id, ordinal, string_agg(turn, ' ' ORDER BY sequence) AS text FROM t WHERE turn IS NOT NULL GROUP BY 1, 2) SELECT conv_id, ordinal, CAST(len(text) AS BIGINT) AS chars, md5(text) AS digest FROM g""",
    "passage_focus": f"WITH {_M} SELECT conv_id, (ordinal - 1) // 4 AS chunk, min(ordinal) AS first, max(ordinal) AS last FROM m WHERE (conv_id + ordinal) % 3 = 0 GROUP BY 1, 2",
    "passage_literals": rf"WITH {_M}, {_RANGES} SELECT conv_id, chunk FROM r WHERE regexp_matches(text, '(?i)of\s+the') AND contains(text, 'The')",
    "chunk_distribution": f"WITH {_M}, {_RANGES} SELECT conv_id, count(*) AS chunks FROM r GROUP BY 1 ORDER BY chunks DESC, conv_id LIMIT 12",
    "embedding_budget": """WITH k AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL))
SELECT key, greatest((SELECT count(*) FROM k) - 20, 0) AS "left" FROM k ORDER BY key LIMIT 20""",
    "store_eviction": f"""WITH {_EV}, s AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(sum(k) AS BIGINT) AS size, max(event_id) * 13 % 400 + 100 AS d FROM e GROUP BY 1), u AS (SELECT key, size, CASE WHEN size % 3 = 0 AND d < 443 THEN 450 ELSE d END AS used_day FROM s) SELECT * FROM u WHERE used_day >= 263""",
    "evidence_passages": f"""WITH {_M}, {_SCORED}, b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY hybrid DESC, score DESC, word_match DESC, chunk) AS k, hybrid, score, word_match, chunk FROM y),
c AS (SELECT conv_id FROM b WHERE k = 1 ORDER BY hybrid DESC, score DESC, word_match DESC, conv_id LIMIT 5) SELECT conv_id, chunk, round(hybrid, 6) AS hybrid, round(word_match, 6) AS word_match FROM y WHERE conv_id IN (SELECT conv_id FROM c)""",
    "hybrid_hits": f"""WITH {_M}, {_hits()}, {_SCORED},
l AS MATERIALIZED (SELECT conv_id, ordinal AS first, ordinal AS last, CASE WHEN ordinal % 5 = 0 THEN 0 ELSE 1 END AS kind, round(score, 6) AS evidence FROM h WHERE conv_id % 3 < 2),
n AS MATERIALIZED (SELECT conv_id, first, CASE WHEN chunk % 2 = 0 THEN first ELSE last END AS last, round(hybrid, 6) AS evidence FROM y WHERE conv_id % 3 > 0),
lr AS (SELECT conv_id, row_number() OVER (ORDER BY evidence DESC, conv_id, first) AS r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY evidence DESC, first) AS k FROM l) WHERE k = 1),
nr AS (SELECT conv_id, row_number() OVER (ORDER BY evidence DESC, conv_id, first) AS r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY evidence DESC, first) AS k FROM n) WHERE k = 1),
n1 AS (SELECT conv_id, first, last, max(evidence) AS evidence FROM n GROUP BY 1, 2, 3),
f AS (SELECT conv_id, first, last, l.kind, l.evidence AS le, n1.evidence AS ne FROM l FULL JOIN n1 USING (conv_id, first, last)),
o AS (SELECT f.*, coalesce(1.0::DOUBLE / (60 + lr.r), 0) + coalesce(1.0::DOUBLE / (60 + nr.r), 0) AS fused, greatest(le, ne) AS evidence, CASE WHEN kind = 0 THEN 0 WHEN kind IS NOT NULL THEN 1 ELSE 3 END AS way FROM f LEFT JOIN lr USING (conv_id) LEFT JOIN nr USING (conv_id))
SELECT conv_id, first, last, CAST(CASE WHEN kind = 0 THEN 0 WHEN kind IS NOT NULL AND ne IS NOT NULL THEN 2 WHEN kind IS NOT NULL THEN 1 ELSE 3 END AS BIGINT) AS hit_kind, round(evidence, 6) AS evidence, round(fused, 9) AS fused FROM (SELECT * FROM o ORDER BY o.fused DESC, way, o.evidence DESC, conv_id, first LIMIT 40)""",
    "early_stop": f"""WITH {_M}, x AS (SELECT DISTINCT conv_id, conv_id * 17 % 61 AS rank FROM m WHERE conv_id < 60), y AS (SELECT *, coalesce(sum((conv_id % 4 = 0)::INT) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x) SELECT conv_id, rank FROM y WHERE b < 5""",
    "search_coverage": f"{_rank()}, c AS (SELECT count(*) AS n FROM r) SELECT n AS matched, greatest(least(n - 3, 7), 0) AS searched, CAST(3 AS BIGINT) AS \"offset\", CASE WHEN 3 + greatest(least(n - 3, 7), 0) < n THEN 3 + greatest(least(n - 3, 7), 0) END AS next_offset FROM c",
    "literal_in_project": f"WITH {_M} SELECT conv_id, round({_fresh('max(second)')}, 6) AS score FROM m GROUP BY conv_id HAVING conv_id % 7 = 3",
    "message_receivers": f"""WITH {_EV}, s AS (SELECT user_id % 5 AS shard, event_id AS started, 't' || (event_id % 7) AS thread, unnest(list_distinct(['n' || (k % 6), 'n' || (k % 4)])) AS name FROM e WHERE event_type = 'click'),
m AS (SELECT event_id, user_id % 5 AS shard, 'n' || (k % 8) AS recipient, 't' || (user_id % 7) AS sender FROM e WHERE event_type = 'purchase')
SELECT event_id, recipient, max_by(thread, started) AS thread FROM m LEFT JOIN s ON s.shard = m.shard AND name = recipient AND started < event_id AND thread <> sender GROUP BY 1, 2""",
    "rollout_chains": f"""WITH RECURSIVE {_EV}, r AS MATERIALIZED (SELECT user_id AS thread, event_id * 7 % 10007 AS ts, event_id AS id, CASE WHEN event_id % 17 = 0 THEN -1 WHEN event_id % 29 = 0 THEN event_id ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS base, k FROM e),
c(thread, id, base, k, depth, stop) AS (SELECT thread, id, base, k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM r QUALIFY row_number() OVER (PARTITION BY thread ORDER BY ts DESC, id DESC) = 1
  UNION ALL SELECT r.thread, r.id, r.base, r.k, c.depth + 1, c.k FROM c JOIN r ON r.thread = c.thread AND r.id = c.base WHERE c.base <> c.id)
SELECT thread, id AS rollout_id, depth, stop AS "end" FROM c""",
    "run_activities": f"""WITH {_EV}, t AS (SELECT user_id, ['Shell', 'Shell', 'Read', 'Grep', 'Other'][k % 5 + 1] AS tool, CASE WHEN k % 5 < 2 THEN greatest(event_id % 4, 1) ELSE 1 END AS n FROM e WHERE event_id % 3 = 0), c AS (SELECT user_id, tool, sum(n) AS n FROM t GROUP BY 1, 2),
p AS (SELECT user_id, CASE tool WHEN 'Grep' THEN 1 WHEN 'Read' THEN 2 WHEN 'Shell' THEN 3 ELSE 4 END AS o, CASE tool WHEN 'Grep' THEN 'Searched for ' WHEN 'Read' THEN 'read ' WHEN 'Shell' THEN 'ran ' ELSE 'called ' END || CAST(n AS BIGINT)
  || CASE tool WHEN 'Grep' THEN ' pattern' WHEN 'Read' THEN ' file' WHEN 'Shell' THEN ' shell command' ELSE ' tool' END || CASE WHEN n = 1 THEN '' ELSE 's' END AS x FROM c), q AS (SELECT user_id, string_agg(x, ', ' ORDER BY o) AS x FROM p GROUP BY 1) SELECT user_id, upper(x[1]) || x[2:] AS activity FROM q""",
    "kimi_entries": """WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) AS path, turn + 1 AS line, left(text, 80) AS t FROM conversations WHERE text IS NOT NULL),
a AS (SELECT path, line, CASE WHEN turn % 3 = 1 THEN 'tool_use' WHEN turn % 2 = 0 THEN 'text' ELSE 'thinking' END AS kind, 'assistant' AS role, CASE WHEN turn % 3 = 1 THEN 'c' || turn END AS call_id, CASE WHEN turn % 3 = 1 THEN 'Shell' END AS tool, CASE WHEN turn % 3 = 0 THEN md5(t) END AS digest, NULL AS label, NULL::BIGINT AS output_tokens FROM c WHERE role = 'assistant' AND (turn % 3 = 1 OR (turn % 3 = 0 AND t <> ''))),
u AS (SELECT path, line, 'text' AS kind, 'user' AS role, NULL AS call_id, NULL AS tool, md5(t) AS digest, NULL AS label, NULL::BIGINT AS o FROM c WHERE role <> 'assistant' AND turn % 5 <> 4 AND turn % 4 <> 2 AND t <> ''),
g AS (SELECT path, line, 'meta', NULL, NULL, NULL, NULL::VARCHAR, 'Usage', turn % 2 FROM c WHERE role <> 'assistant' AND turn % 5 = 4 AND turn % 2 = 1),
d AS (SELECT path, min(line), 'meta', NULL, NULL, NULL, md5('m' || (conv_id % 2)), 'Model', NULL::BIGINT FROM c WHERE role <> 'assistant' AND turn % 5 = 4 GROUP BY path, conv_id)
SELECT * FROM a UNION ALL SELECT * FROM u UNION ALL SELECT * FROM g UNION ALL SELECT * FROM d""",
    "pi_entries": """WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) AS path, turn + 1 AS line, left(text, 80) AS t FROM conversations WHERE text <> '')
SELECT path, line, CAST(0 AS BIGINT) AS part, 'meta' AS kind, NULL AS role, NULL AS call_id, md5('m') AS digest, 'Model' AS label FROM c WHERE turn % 5 = 4
UNION ALL SELECT path, line, 0, 'text', CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END, NULL, md5(t), NULL FROM c WHERE turn % 5 <> 4 AND turn % 4 <> 3
UNION ALL SELECT path, line, 0, 'tool_use', 'user', 'i' || turn, NULL, NULL FROM c WHERE turn % 5 <> 4 AND turn % 4 = 3
UNION ALL SELECT path, line, 1, 'tool_result', 'user', 'i' || turn, md5('out' || turn || CASE WHEN turn % 2 = 1 THEN chr(10) || 'exit code 1' ELSE '' END), NULL FROM c WHERE turn % 5 <> 4 AND turn % 4 = 3""",
    "database_entries": """WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) AS cid, 'm' || turn AS mid, left(text, 80) AS t FROM conversations WHERE text <> ''),
a AS MATERIALIZED (SELECT * FROM c WHERE role = 'assistant' AND turn % 7 <> 6),
n AS (SELECT *, lag(turn // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM a)
SELECT cid AS conv_id, mid AS message_id, 'meta' AS kind, NULL AS role, NULL AS reply_id, NULL AS call_id, md5('x' || (turn // 4)) AS digest, 'Model' AS label FROM n WHERE b IS NULL OR b <> turn // 4
UNION ALL SELECT cid, mid, 'text', 'user', NULL, NULL, md5(t), NULL FROM c WHERE role = 'user' AND turn % 3 <> 1 AND turn % 7 <> 6
UNION ALL SELECT cid, mid, 'text', 'assistant', 'p' || turn, NULL, md5(t), NULL FROM a WHERE turn % 3 <> 1
UNION ALL SELECT cid, mid, 'tool_use', 'assistant', 'p' || turn, 'p' || turn, NULL, NULL FROM a WHERE turn % 3 = 1
UNION ALL SELECT cid, mid, 'tool_result', 'user', NULL, 'p' || turn, md5('o' || turn), NULL FROM a WHERE turn % 3 = 1 AND turn % 2 = 1""",
    "split_calls": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(left(text, 200), '[^\p{L}]+')[1:4], lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS piece FROM w)
SELECT CASE WHEN piece = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '#' || piece END AS call_id, piece, 'Edit' AS tool, w[piece] AS file FROM p""",
    "hook_texts": f"""WITH {_M}, n AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS path, ordinal AS line, CASE WHEN ordinal % 4 = 0 THEN 'tool_use' ELSE 'tool_result' END AS kind, 'c' || (ordinal // 4) AS call_id, 't' || ordinal AS text FROM m WHERE ordinal % 2 = 0),
k AS (SELECT CAST(conv_id AS VARCHAR) AS path, ordinal AS line, 'c' || (ordinal // 3) AS call_id, 'h' || ordinal AS text FROM m WHERE ordinal % 2 = 1),
o AS (SELECT path, call_id, arg_min(line, (kind <> 'tool_result', line)) AS line FROM n GROUP BY 1, 2),
j AS (SELECT k.path, o.line, k.call_id, string_agg(k.text, chr(10) ORDER BY k.line) FILTER (k.line < o.line) AS b, string_agg(k.text, chr(10) ORDER BY k.line) FILTER (k.line >= o.line) AS a FROM k JOIN o USING (path, call_id) GROUP BY ALL)
SELECT n.path, n.line, kind, n.call_id, concat_ws(chr(10), b, text, a) AS text FROM n LEFT JOIN j ON j.path = n.path AND j.line = n.line
UNION ALL SELECT path, line, 'hook', call_id, text FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = k.path AND o.call_id = k.call_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
