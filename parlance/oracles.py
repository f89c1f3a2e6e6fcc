"""DuckDB SQL for the queries of ``parlance.queries``."""

_SEPARATORS = r"_\-/、。，．・：；？！（）「」『』【】〈〉《》〔〕［］｛｝～"
_DAYS = "(1704672000 - least({}, 1704672000)) / 86400.0"


def _collapse(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _normal(t: str) -> str:
    return rf"lower(regexp_replace({t}, '[\s{_SEPARATORS}]', ' ', 'g'))"


def _prefix(t: str, word: str, cap: int = 10) -> str:
    """Occurrences at word starts."""
    last = word[-1]
    pieces = f"string_split({t}, '{word}')"
    before = f"CASE WHEN x <> '' THEN right(x, 1) WHEN i = 1 THEN '' ELSE '{last}' END"
    return rf"least(len(list_filter({pieces}[1:len({pieces}) - 1], lambda x, i: NOT regexp_matches({before}, '[\p{{L}}\p{{N}}]'))), {cap})"


def _pairs(t: str, words: list[str], cap: int = 3) -> str:
    return f"least({' + '.join(_prefix(t, f'{a} {b}', cap) for a, b in zip(words, words[1:], strict=False))}, {cap})"


def _fresh(second: str) -> str:
    return f"2.0 * pow(2.0, -({_DAYS.format(second)}) / 7.0)"


_M = """m AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, role, coalesce(text, '') AS text,
  1704067200 + conv_id * 3600 + turn * 60 AS second FROM conversations)"""
_IN = "second >= 1704153600 AND second <= 1704283380"
_LOW = _normal(_collapse("text"))
_DOCS = f"docs AS (SELECT doc_id, {_LOW} AS low FROM documents)"


def _rank(where: str = "true", words: tuple[str, ...] = ("the", "of"), fields: bool = False) -> str:
    counts = ", ".join(f"least(sum({_prefix('low', w)}), 10) AS w{i}" for i, w in enumerate(words))
    body = " + ".join(f"ln(1.0 + w{i})" for i in range(len(words)))
    keep = [f"w{i} > 0" for i in range(len(words))]
    extra = "0.0"
    joined = "s"
    if fields:
        parts = []
        for name, weight in (("title", 5.0), ("project", 4.0)):
            sums = " + ".join(f"ln(1.0 + {_prefix(name, w)})" for w in words)
            parts.append(f"{weight} * ({sums} + 2.0 * {_pairs(name, list(words))})")
        extra = " + ".join(parts)
        keep = [f"({k} OR {_prefix('project', w)} > 0)" for k, w in zip(keep, words, strict=True)]
        joined = "s JOIN f USING (conv_id)"
    title = f"""f AS (SELECT conv_id, left(min_by(text, ordinal), 60) AS raw, {_normal("left(min_by(text, ordinal), 60)")} AS title, 'the project ' || (conv_id % 7) AS project FROM m GROUP BY conv_id),""" if fields else ""
    titles = f" UNION ALL SELECT conv_id, NULL, {_normal(_collapse('raw'))} FROM f WHERE raw <> ''" if fields else ""
    return f"""WITH {_M}, {title}
t AS MATERIALIZED (SELECT conv_id, second, {_LOW} AS low FROM m WHERE {where}{titles}),
s AS (SELECT conv_id, max(second) AS ranked_second, {counts}, least(sum({_pairs("low", list(words))}), 3) AS pairs FROM t GROUP BY conv_id),
r AS (SELECT conv_id, {body} AS body, CAST(pairs AS BIGINT) AS pairs, {_fresh("ranked_second")} AS fresh, CAST(ranked_second AS BIGINT) AS ranked_second,
  {body} + 2.0 * pairs + {extra} + {_fresh("ranked_second")} AS score FROM {joined} WHERE {" AND ".join(keep)})"""


#: Messages as parts, as in the queries.
_P = """base AS (SELECT conv_id, ordinal, role, text, len(text) // 2 AS cut, CASE WHEN ordinal % 5 = 4 THEN 'a' || (ordinal % 2) ELSE '' END AS thread, ['thinking', 'text', 'tool_use', 'tool_result'][ordinal % 4 + 1] AS k2 FROM m),
parts AS MATERIALIZED (SELECT conv_id, ordinal, 1::BIGINT AS position, role, thread, 'text' AS kind, NULL::VARCHAR AS call_id, left(text, cut) AS text FROM base
  UNION ALL SELECT conv_id, ordinal, 2, role, thread, k2, CASE WHEN starts_with(k2, 'tool') THEN 'c' || (ordinal % 6) END, substr(text, cut + 1) FROM base)"""
_SHOWN = "kind NOT IN ('tool_use', 'thinking') AND thread = ''"
_SEG = f"""{_P}, seg AS MATERIALIZED (SELECT conv_id, ordinal, position, text, CASE kind WHEN 'text' THEN 0 WHEN 'thinking' THEN 2 ELSE 1 END AS source,
  CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id, ordinal ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM parts)"""


def _segment_hits(word: str | None) -> str:
    """Messages with a word, in any segment, and "of the" within one; offsets in bytes."""
    hit = f"{_prefix(_normal('text'), word, 1)} > 0" if word else "false"
    return f"""{_SEG}, t AS (SELECT *, {hit} AS w, string_split_regex(text, '(?i)of\\s+the') AS x FROM seg),
q AS (SELECT *, len(x) > 1 AS l FROM t),
g AS (SELECT conv_id, ordinal, min(CASE WHEN w THEN start WHEN l THEN start + strlen(x[1]) END) AS a, max(CASE WHEN w THEN start + strlen(text) WHEN l THEN start + strlen(text) - strlen(x[-1]) END) AS b,
  min(CASE WHEN w OR l THEN source END) AS source, string_agg(text, chr(10) ORDER BY position) AS body FROM q GROUP BY 1, 2 HAVING bool_or(l) AND {"bool_or(w)" if word else "true"}),
n AS (SELECT conv_id, ordinal, second, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
h AS (SELECT conv_id, ordinal, second, {8.0 + 3.0 if word else 4.0 + 3.0} + 1.0 / greatest(b - a, 1) AS score, source, a, greatest(ordinal - 1, 1) AS read_first, least(ordinal + 1, n) AS read_last, decode(encode(body)[1:a]) AS x, decode(encode(body)[a + 1:b]) AS y, decode(encode(body)[b + 1:]) AS z FROM g JOIN n USING (conv_id, ordinal))"""


_BYTES = "greatest(strlen(text), 1)"


def _hits(words: tuple[str, ...] = ("the", "of"), name: str = "h") -> str:
    low = _normal("text")
    tests = " AND ".join(f"{_prefix(low, w, 1)} > 0" for w in words)
    pairs = " + ".join(["0.0", *(f"CASE WHEN contains({low}, '{a} {b}') THEN 2.0 ELSE 0.0 END" for a, b in zip(words, words[1:], strict=False))])
    return f"""{name} AS MATERIALIZED (SELECT conv_id, ordinal, second, {4.0 * len(words)} + {pairs} + 1.0 / {_BYTES} AS score,
  CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE 1 END AS source, greatest(ordinal - 1, 1) AS read_first, least(ordinal + 1, n) AS read_last
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM m) WHERE {tests})"""


_H = f"WITH {_M}, {_hits()}"
_FOLD = f"""WITH {_M}, u AS (SELECT conv_id, min(ordinal) FILTER (role = 'user') AS first_user FROM m GROUP BY conv_id),
p AS (SELECT conv_id, list(left({_collapse("text")}, 80) ORDER BY ordinal) AS t FROM m JOIN u USING (conv_id) WHERE role IN ('user', 'assistant') AND ordinal >= first_user GROUP BY conv_id)"""
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_E = f"e AS MATERIALIZED (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_SHARE = "(CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END)"
_HYBRID = f"WITH {_E}, p AS (SELECT doc_id, score, {_SHARE.format('the', 'of', 'und')} / 3.0 AS word_match, score + 0.2 * ({_SHARE.format('the', 'of', 'und')} / 3.0) AS hybrid FROM documents JOIN e ON doc_id = vec_id)"
_EV = "ev AS MATERIALIZED (SELECT *, epoch_us(ts) AS us FROM events)"
_RUN = "ORDER BY us, event_id"
_TURN = r"regexp_replace(text, '(?s)```.*?(?:```|\z)', ' ', 'g')"
for _tag in ("system-reminder", "local-command-stdout", "command-name", "command-message", "task-notification", "ide-diagnostics"):
    _TURN = rf"regexp_replace({_TURN}, '(?s)<{_tag}>.*?(?:</{_tag}>|\z)', ' ', 'g')"

_TERMS = [a + b for a in "tiaoeund" for b in "heninrst"]

SQL = {
    "normalize_text": f"SELECT doc_id, md5({_LOW}) AS digest FROM documents",
    "prefix_count": f"WITH {_DOCS} SELECT doc_id, {', '.join(f'CAST({_prefix("low", w)} AS BIGINT) AS n_{w}' for w in ('the', 're', 'un'))} FROM docs",
    "adjacent_pairs": f"WITH {_DOCS} SELECT doc_id, CAST({_pairs('low', ['of', 'the', 'in'])} AS BIGINT) AS pairs FROM docs",
    "literal_match_smartcase": r"SELECT doc_id, regexp_matches(text, '(?i)the\s+of') AS lower, regexp_matches(text, 'The\s+of') AS cased FROM documents",
    "literal_whitespace_runs": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)of\s+the')) AS BIGINT) AS n FROM documents",
    "cjk_contains": "SELECT lang, count(*) FILTER (regexp_matches(text, '[一-鿿]')) AS with_cjk, count(*) AS n FROM documents GROUP BY lang",
    "word_match_share": f"SELECT doc_id, round({_SHARE.format('the', 'und', 'les')} / 4.0, 6)::DOUBLE AS share FROM documents",
    "matched_terms": f"WITH {_DOCS} SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {_prefix('low', w, 1)} > 0 THEN '{w}' END" for w in ('the', 'und', 'les'))}) AS terms FROM docs".replace("AS low FROM documents", "AS low FROM documents"),
    "message_numbering": f"""WITH {_M}, e AS (SELECT *, CASE WHEN ordinal % 3 = 2 THEN 'b' WHEN ordinal % 7 = 0 THEN 'a' ELSE '' END AS thread, CASE WHEN role = 'assistant' THEN 'r' || (ordinal // 4) END AS reply FROM m),
v AS (SELECT *, trim(text) <> '' AS said, role = 'user' AND trim(text) <> '' AS usr FROM e),
c AS (SELECT *, usr AND trim(text) = 'Warmup' AND sum(usr::INT) OVER w = 1 AS warm FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal)),
s AS (SELECT *, said AND NOT warm AND (role <> 'assistant' OR max((usr AND NOT warm)::INT) OVER w = 1) AS seen FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal)),
k AS (SELECT *, seen AND (reply IS NULL OR ordinal = min(ordinal) FILTER (seen) OVER (PARTITION BY conv_id, thread, reply)) AS starts FROM s),
o AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id ORDER BY ordinal) AS n, min(ordinal) OVER (PARTITION BY conv_id, thread) AS t1 FROM k),
x AS (SELECT *, CASE WHEN NOT seen THEN NULL WHEN reply IS NULL THEN n ELSE min(n) FILTER (seen) OVER (PARTITION BY conv_id, thread, reply) END AS num FROM o)
SELECT conv_id, ordinal AS sequence, CAST(num AS BIGINT) AS ordinal, starts, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY CASE WHEN thread = '' THEN -1 ELSE t1 END) - 1 AS BIGINT) AS thread_number,
  row_number() OVER (PARTITION BY conv_id, thread ORDER BY ordinal) AS position FROM x""",
    "visible_messages": f"WITH {_M}, {_P} SELECT conv_id, ordinal, count(*) AS parts FROM parts WHERE {_SHOWN} AND (kind IN ('tool_use', 'tool_result') OR {_collapse('text')} <> '') GROUP BY 1, 2",
    "hidden_part_counts": f"""WITH {_M}, {_P} SELECT conv_id, ordinal, count(*) FILTER (thread = '' AND kind = 'tool_use') AS tools, count(*) FILTER (false) AS results,
  count(*) FILTER (thread = '' AND kind = 'thinking') AS thoughts, count(*) FILTER (thread <> '') AS subagent_parts FROM parts GROUP BY 1, 2""",
    "call_numbers": f"WITH {_M}, {_P} SELECT conv_id, ordinal, position, row_number() OVER (PARTITION BY conv_id, ordinal ORDER BY position) AS number FROM parts WHERE kind = 'tool_use'",
    "thread_handles": f"WITH {_M}, {_P}, t AS (SELECT conv_id, thread, min(ordinal) AS f FROM parts WHERE thread <> '' GROUP BY 1, 2) SELECT conv_id, thread, 's' || row_number() OVER (PARTITION BY conv_id ORDER BY f, thread) AS handle FROM t",
    "segment_offsets": f"WITH {_M}, {_SEG} SELECT conv_id, ordinal, position, CAST(source AS BIGINT) AS source, start FROM seg",
    "segment_hits": f"WITH {_M}, {_segment_hits('the')} SELECT conv_id, ordinal, round(score, 6) AS score, CAST(source AS BIGINT) AS source, a AS \"offset\", read_first, read_last, md5(left({_collapse('right(x, 41) || y || left(z, 80)')}, 160)) AS digest FROM h",
    "dialogue_first_hits": f"WITH {_M}, {_segment_hits(None)} SELECT conv_id, ordinal, CAST(source AS BIGINT) AS source, round(score, 6) AS score FROM (SELECT * FROM h ORDER BY h.source, h.score DESC, second DESC, conv_id, ordinal, a LIMIT 30)",
    "time_inheritance": f"""WITH {_M} SELECT conv_id, ordinal, CAST(coalesce(last_value(CASE WHEN ordinal % 3 = 0 THEN second END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), conv_id * 10) AS BIGINT) AS second FROM m""",
    "launch_links": f"""WITH {_M}, c AS (SELECT conv_id, 'c' || (ordinal * 2 // 3) AS launch, min(ordinal) AS ordinal FROM m GROUP BY 1, 2 HAVING count(*) = 1)
SELECT t.conv_id, t.launch, c.ordinal FROM (SELECT conv_id, 'c' || (ordinal // 2) AS launch FROM m WHERE ordinal % 2 = 0) t LEFT JOIN c USING (conv_id, launch)""",
    "session_fold": f"""WITH {_M} SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'assistant') AS assistant_messages, CAST(sum(len(text)) AS BIGINT) AS chars,
  CAST(min(second) AS BIGINT) AS first_second, CAST(max(second) AS BIGINT) AS last_second, CASE WHEN (max(second) - min(second)) // 60 > 0 THEN CAST((max(second) - min(second)) // 60 AS BIGINT) END AS duration_minutes FROM m GROUP BY conv_id""",
    "session_previews": f"{_FOLD} SELECT u.conv_id, coalesce(array_to_string(t[1:3], ' ... '), '') AS preview_first, coalesce(array_to_string(list_reverse(t[greatest(len(t) - 2, 1):len(t)]), ' ... '), '') AS preview_last FROM u LEFT JOIN p USING (conv_id)",
    "sessions_in_window": f"WITH {_M} SELECT conv_id, count(*) AS in_window, CAST(min(second) AS BIGINT) AS first_second, CAST(max(second) AS BIGINT) AS last_second FROM m WHERE {_IN} GROUP BY conv_id",
    "sessions_listing": f"WITH {_M} SELECT conv_id, count(*) AS in_window, CAST(min(second) AS BIGINT) AS first_second, CAST(max(second) AS BIGINT) AS last_second FROM m GROUP BY conv_id ORDER BY last_second DESC, conv_id LIMIT 20 OFFSET 5",
    "window_runs": f"""WITH {_M}, k AS (SELECT conv_id, ordinal, ordinal - row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) AS island FROM m WHERE {_IN} AND {_prefix(_normal("text"), "the", 1)} > 0)
SELECT conv_id, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM k GROUP BY conv_id, island""",
    "empty_sessions": f"WITH {_M} SELECT conv_id, count(*) AS message_count, CAST(max(second) AS BIGINT) AS last_second FROM m GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0",
    "lexical_rank": f"{_rank(fields=True)} SELECT conv_id, round(score, 6) AS score, round(body, 6) AS body, pairs, ranked_second FROM (SELECT * FROM r ORDER BY r.score DESC, r.ranked_second DESC, conv_id LIMIT 10)",
    "lexical_rank_windowed": f"{_rank(_IN)} SELECT conv_id, round(score, 6) AS score, pairs, ranked_second FROM r",
    "lexical_explain": f"{_rank()} SELECT conv_id, round(score, 6) AS score, round(body, 6) AS body, pairs, round(fresh, 6) AS fresh FROM r",
    "exact_phrase_rank": rf"WITH {_M} SELECT conv_id, round({_fresh('max(second)')}, 6) AS score, CAST(max(second) AS BIGINT) AS ranked_second FROM m GROUP BY conv_id HAVING bool_or(regexp_matches(text, '(?i)of\s+the'))",
    "browse_freshness": f"WITH {_M} SELECT conv_id, round({_fresh('max(second)')}, 6) AS score FROM m GROUP BY conv_id",
    "hit_messages_bitmask": f"""WITH {_M}, l AS MATERIALIZED (SELECT conv_id, {_normal('text')} AS low FROM m), k AS (SELECT conv_id, {" | ".join(f"(CASE WHEN {_prefix('low', w, 1)} > 0 THEN ({1 << i if i < 63 else -(1 << 63)})::BIGINT ELSE 0::BIGINT END)" for i, w in enumerate(_TERMS))} AS mask FROM l)
SELECT conv_id, bit_or(mask) AS mask, count(*) FILTER (mask = -1) AS full_messages FROM k GROUP BY conv_id""",
    "within_hits": f"{_H} SELECT conv_id, ordinal, round(score, 6) AS score, CAST(source AS BIGINT) AS source, read_first, read_last FROM (SELECT * FROM h ORDER BY h.score DESC, second DESC, conv_id, ordinal, source LIMIT 20)",
    "preview_text": rf"""WITH {_M}, t AS (SELECT *, string_split_regex(text, '(?i)of\s+the') AS p FROM m), u AS (SELECT *, len(p[1]) AS a, len(text) - len(p[-1]) AS b FROM t WHERE len(p) > 1),
k AS (SELECT conv_id, ordinal, left({_collapse("right(left(text, a), 41) || substr(text, a + 1, b - a) || left(substr(text, b + 1), 80)")}, 160) AS preview FROM u) SELECT conv_id, ordinal, CAST(len(preview) AS BIGINT) AS chars, md5(preview) AS digest FROM k""",
    "flat_hits_topk": f"{_H} SELECT conv_id, ordinal, round(score, 6) AS score FROM (SELECT * FROM h ORDER BY floor(h.score * 10) DESC, source, h.score DESC, conv_id, ordinal LIMIT 15)",
    "grouped_hits": f"""{_H}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY floor(score * 10) DESC, source, score DESC, ordinal) AS rank, count(*) OVER (PARTITION BY conv_id) AS total_hits FROM h),
g AS (SELECT *, max(score) OVER (PARTITION BY conv_id) AS group_score FROM k WHERE rank <= 2), b AS (SELECT conv_id FROM g GROUP BY conv_id ORDER BY max(group_score) DESC, conv_id LIMIT 10)
SELECT conv_id, rank, ordinal, round(score, 6) AS score, total_hits, round(group_score, 6) AS group_score FROM g JOIN b USING (conv_id)""",
    "dedup_hits": f"""{_H}, {_hits(("the",), "h2")} SELECT conv_id, ordinal, CAST(source AS BIGINT) AS source, min(read_first) AS read_first, max(read_last) AS read_last, round(max(score), 6) AS score, count(*) AS merged
FROM (SELECT * FROM h UNION ALL SELECT * FROM h2) GROUP BY conv_id, ordinal, source""",
    "cosine_topk": f"WITH {_E} SELECT vec_id, label, round(score, 6) AS score FROM (SELECT * FROM e ORDER BY e.score DESC, vec_id LIMIT 20)",
    "best_per_conversation": f"WITH {_E} SELECT label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM e) WHERE k = 1",
    "hybrid_passage_score": f"{_HYBRID} SELECT doc_id, round(hybrid, 6) AS hybrid, round(word_match, 6)::DOUBLE AS word_match FROM (SELECT * FROM p ORDER BY p.hybrid DESC, score DESC, doc_id LIMIT 25)",
    "quality_buckets": f"""{_HYBRID}, k AS (SELECT CASE WHEN hybrid >= 0.85 THEN 'strong' WHEN hybrid >= 0.65 THEN 'good' WHEN hybrid >= 0.35 THEN 'fair' ELSE 'weak' END AS quality, word_match FROM p)
SELECT quality, CASE WHEN quality = 'weak' THEN 'weak-match' WHEN word_match > 0 THEN 'lexical-boosted' ELSE 'semantic-only' END AS reason, count(*) AS n FROM k GROUP BY ALL""",
    "turn_filter": f"WITH {_M}, k AS (SELECT conv_id, ordinal, {_collapse(_TURN)} AS t FROM m) SELECT conv_id, ordinal, CAST(len(t) AS BIGINT) AS chars, md5(t) AS digest FROM k WHERE t <> '' AND NOT starts_with(t, '/')",
    "passage_chunks": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
p(doc_id, chunk, t) AS (SELECT doc_id, CAST(0 AS BIGINT), t FROM d WHERE t <> '' UNION ALL SELECT doc_id, chunk + 1, regexp_replace(substr(t, 2101), '^\s+', '') FROM p WHERE len(t) > 2400)
SELECT doc_id, chunk, md5({_collapse("left(t, 2400)")}) AS digest FROM p WHERE t <> ''""",
    "embedding_lookup_missing": "SELECT sha256(text) AS key, count(*) AS uses FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1",
    "rrf_fusion": f"""{_rank()}, {_E}, a AS (SELECT conv_id, row_number() OVER (ORDER BY score DESC, ranked_second DESC, conv_id) AS lexical_rank FROM r QUALIFY lexical_rank <= 80),
b AS (SELECT vec_id AS conv_id, row_number() OVER (ORDER BY score DESC, vec_id) AS semantic_rank FROM e QUALIFY semantic_rank <= 80),
f AS (SELECT conv_id, lexical_rank, semantic_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS fused FROM a FULL JOIN b USING (conv_id))
SELECT conv_id, lexical_rank, semantic_rank, round(fused, 9) AS fused FROM (SELECT * FROM f ORDER BY f.fused DESC, conv_id LIMIT 30)""",
    "read_range_rows": f"WITH {_M} SELECT conv_id, ordinal, role, CAST(len(text) AS BIGINT) AS chars FROM m WHERE conv_id = 3 AND ordinal BETWEEN 2 AND 4",
    "tail_messages": f"WITH {_M} SELECT conv_id, ordinal, role FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ordinal DESC) <= 2",
    "line_slice": "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), e AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS line FROM l) SELECT doc_id, line, CAST(len(a[line]) AS BIGINT) AS chars FROM e WHERE line BETWEEN 2 AND 4",
    "match_context_lines": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), e AS (SELECT doc_id, line, contains(lower(a[line]), 'license') AS match FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS line FROM l)),
n AS (SELECT *, bool_or(match) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM e) SELECT doc_id, line, match FROM n WHERE near""",
    "outline_segments": f"""WITH {_M}, k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) - 1) // 3 AS segment FROM m)
SELECT conv_id, segment, min(ordinal) AS first, max(ordinal) AS last, count(*) FILTER (role = 'user') AS users, CAST(sum(len(text)) AS BIGINT) AS chars,
  min_by(left({_collapse("text")}, 80), ordinal) AS first_snippet, max_by(left({_collapse("text")}, 80), ordinal) AS last_snippet FROM k GROUP BY conv_id, segment""",
    "repeat_detection": f"WITH {_M}, {_P} SELECT conv_id, ordinal, position, min(ordinal) OVER (PARTITION BY conv_id, thread, kind = 'tool_use', text) AS same_as FROM parts",
    "chars_before": f"WITH {_M} SELECT conv_id, ordinal, CAST(coalesce(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM m",
    "call_result_links": """WITH c AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE 'k' || (o_orderkey // CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END) END AS id FROM orders),
u AS (SELECT id FROM c WHERE id <> 'unknown' GROUP BY id HAVING count(*) = 1),
r AS (SELECT l_returnflag, CASE WHEN l_orderkey % 13 = 0 THEN 'unknown' ELSE 'k' || l_orderkey END AS id, CASE WHEN l_orderkey % 13 = 0 THEN 'unknown' ELSE 'k' || l_orderkey || CASE WHEN l_linenumber > 1 THEN '#' || l_linenumber ELSE '' END END AS full_id FROM lineitem)
SELECT l_returnflag, id IN (SELECT id FROM u) AS linked, count(*) AS results, count(DISTINCT full_id) AS ids FROM r GROUP BY 1, 2""",
    "day_markers": f"WITH {_EV}, k AS (SELECT user_id, event_id, us // 86400000000 AS day, lag(us // 86400000000) OVER (PARTITION BY user_id {_RUN}) AS b FROM ev) SELECT user_id, event_id, CAST(day AS BIGINT) AS day FROM k WHERE b IS NULL OR b <> day",
    "tool_run_summary": f"""WITH {_EV}, c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY user_id {_RUN})),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id {_RUN}) AS BIGINT) AS run FROM c) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY ALL""",
    "model_changes": f"WITH {_EV}, c AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id {_RUN}) AS b FROM ev) SELECT event_type, count(*) AS n FROM c WHERE b IS NULL OR b <> event_type GROUP BY 1",
    "as_of_links": f"WITH {_EV} SELECT p.event_id, p.user_id, (SELECT max_by(c.event_id, (c.us, c.event_id)) FROM ev c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.us < p.us) AS linked FROM ev p WHERE p.event_type = 'purchase'",
    "splice_merge": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(trunc(event_id * 37 % 101 + event_id / 40.0) AS BIGINT) END AS t FROM events),
p AS (SELECT user_id, event_id, t FROM e WHERE event_id % 3 <> 0),
c AS (SELECT user_id, event_id, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM e WHERE event_id % 3 = 0),
a AS (SELECT c.user_id, c.event_id, c.t, min(p.event_id) AS anchor FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.t > c.t GROUP BY ALL),
b AS (SELECT user_id, event_id, event_id AS anchor, 1 AS parent, NULL::BIGINT AS t FROM p UNION ALL SELECT user_id, event_id, coalesce(anchor, 9000000000), 0, coalesce(t, 9000000000) FROM a)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY anchor, parent, t, event_id) AS place, CASE WHEN parent = 1 THEN 'parent' ELSE 'child' END AS origin FROM b""",
    "newest_per_thread": f"WITH {_EV} SELECT user_id, event_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1",
    "version_union_antijoin": "SELECT doc_id, lang, 'new-' || source AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)",
    "handle_prefixes": """WITH i AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS id FROM documents), n AS (SELECT *, lag(id) OVER (ORDER BY id) AS a, lead(id) OVER (ORDER BY id) AS b FROM i),
c AS (SELECT *, coalesce(len(list_filter(range(1, 65), lambda k: left(id, k) = left(a, k))), 0) AS x, coalesce(len(list_filter(range(1, 65), lambda k: left(id, k) = left(b, k))), 0) AS y FROM n) SELECT doc_id, left(id, greatest(x + 1, y + 1, 4)) AS prefix FROM c""",
    "branch_walk": """WITH RECURSIVE r AS (SELECT o_custkey % 3 AS tree, o_orderkey AS node FROM orders WHERE o_orderkey < 6000),
n AS MATERIALIZED (SELECT tree, node, CASE WHEN node % 1999 = 7 THEN lead(node) OVER w WHEN node % 977 = 5 THEN 1000000000 ELSE lag(node) OVER w END AS up FROM r WINDOW w AS (PARTITION BY tree ORDER BY node)),
b(tree, node, depth) AS (SELECT tree, max(node), CAST(0 AS BIGINT) FROM n GROUP BY 1 UNION ALL SELECT n2.tree, n2.node, b.depth + 1 FROM b JOIN n USING (tree, node) JOIN n n2 ON n2.tree = n.tree AND n2.node = n.up WHERE b.depth < 7000)
SELECT tree, node, min(depth) AS depth FROM b GROUP BY 1, 2""",
    "props_extract": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
