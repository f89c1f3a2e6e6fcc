"""DuckDB SQL for the queries of this subpackage."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of a text, A-Z lower-cased.
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+')"

OP10 = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(g.s) AS n_shingles FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
r(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, least(min(other), doc_id) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m USING (doc_id)
"""

_SPACES = r"[^\x20\x09-\x0D]+"
OP9 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
tri AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS MATERIALIZED (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
ln AS MATERIALIZED (SELECT doc_id, host, t, l, regexp_extract_all(l, '{_SPACES}') AS lw FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d)),
lines AS MATERIALIZED (SELECT doc_id, host, t, l, translate(array_to_string(lw, ' '), '{_UP}', '{_LOW}') AS s, len(array_to_string(lw, '')) AS chars FROM ln WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY 1),
often AS (SELECT host, s FROM lines GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, sum(chars) AS n FROM lines JOIN often USING (host, s) GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_chars
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - removed_chars >= 0.3 * word_chars AS kept, removed_chars
FROM b
"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
OP6 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len('<|im_start|>') + len(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + 1 + len({_ESCAPED.format("text")}) + len('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, x[2 * s + 1:2 * s + 100] AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS s FROM d WHERE len(x) >= 100)),
m AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
r AS MATERIALIZED (SELECT doc_id, s FROM w JOIN m USING (g) WHERE m < doc_id),
e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e) GROUP BY doc_id, k),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone, count(*) AS n FROM k GROUP BY 1)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(0, n + 1),
    lambda i: x[2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1:2 * (CASE WHEN i = n THEN len(x) // 2 ELSE a[i + 1] END)]), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""


def _op2(rounds: int = 60) -> str:
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.5}
    steps = [
        rf"""WITH n AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACES}')) AS BIGINT) AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(t, ' | ') THEN 'list' WHEN regexp_matches(t, '[%#*$&]{{3}}') THEN 'symbols'
  WHEN n_tokens >= 300 THEN 'long' WHEN n_tokens >= 60 THEN 'medium' ELSE 'short' END AS topic FROM n),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"""
    ]
    for margin, power in powers.items():
        steps.append(f"""l_{margin} AS MATERIALIZED (SELECT {margin}, s / sum(s) OVER () AS share, least(pow(s, {power}) / sum(pow(s, {power})) OVER (), 2.0 * s / sum(s) OVER ()) AS level FROM (SELECT {margin}, sum(tokens) AS s FROM c GROUP BY {margin} HAVING sum(tokens) > 0)),
t_{margin} AS MATERIALIZED (SELECT {margin}, level / sum(level) OVER () AS target, share FROM l_{margin})""")
    grown = ", ".join(f"(SELECT max(target / share) FROM t_{margin})" for margin in powers)
    steps.append(f"b AS MATERIALIZED (SELECT 1 / (0.7::DOUBLE / greatest({grown}) * (SELECT sum(tokens) FROM c)) AS most)")
    last = "(SELECT *, 1.0::DOUBLE AS w FROM c)"
    for k in range(rounds):
        for margin in powers:
            name = f"r{k}_{margin}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT * EXCLUDE (w, m, target), least(CASE WHEN m > 0 THEN w * coalesce(target, 0) / m ELSE 0 END, (SELECT most FROM b)) AS w FROM (SELECT x.*, target, sum(tokens * w) OVER (PARTITION BY x.{margin}) AS m FROM {last} x LEFT JOIN t_{margin} USING ({margin})))"
            )
            last = name
    return (
        ",\n".join(steps)
        + f""",
p AS MATERIALIZED (SELECT source, lang, topic, w, least(1.0, CASE WHEN tokens > 0 THEN w / (SELECT most FROM b) ELSE 0 END) AS p FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(w * 1e6, 9) AS weight, round(p, 9) AS probability,
  CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / pow(2, 52) < p AS sampled
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    )


OP2 = _op2()
