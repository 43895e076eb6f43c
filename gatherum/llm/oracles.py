"""DuckDB SQL for the queries that SQL can express; written apart from the operators."""

from __future__ import annotations

from gatherum.llm.licences import TEMPLATES, THRESHOLD
from gatherum.llm.sharding import SHARDS, SLOTS

_WORD = r"[^\x20\x09-\x0D]+"

_RATES = {
    "mean_length": "word_chars * 1000 // greatest(n_words, 1)",
    "symbol_rate": "n_symbols * 10000 // greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines * 10000 // greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words * 10000 // greatest(n_words, 1)",
}
OP1 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS words FROM t),
p AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 8),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram FROM p),
twice AS (SELECT rid, unnest(list(i)) AS i FROM g GROUP BY rid, gram HAVING count(*) > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) r(k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
line_counts AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
m AS (
  SELECT t.rid, t.doc_id, t.lang, t.source, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t JOIN w USING (rid) LEFT JOIN line_counts l USING (rid) LEFT JOIN cover c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
r AS ({" UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{k}' AS measure, {v} AS value FROM b" for k, v in _RATES.items())}),
s AS (SELECT lang, source, measure, CASE WHEN value < 64 THEN value ELSE (value >> (len(bin(value)) - 6)::BIGINT) << (len(bin(value)) - 6)::BIGINT END AS low FROM r WHERE NOT base_failed),
pooled AS (SELECT *, CASE measure WHEN 'mean_length' THEN 90 ELSE 99 END AS tail, CASE measure WHEN 'mean_length' THEN 40 ELSE 18 END AS tenths FROM (
  SELECT 0 AS level, lang, source, measure, low FROM s UNION ALL SELECT 1, lang, NULL, measure, low FROM s UNION ALL SELECT 2, NULL, NULL, measure, low FROM s)),
q AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY low) AS k, count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM pooled),
f AS (SELECT level, lang, source, measure, n, tail, tenths, min(CASE WHEN k = (n * 50 + 99) // 100 THEN low END) AS middle, min(CASE WHEN k = (n * (100 - tail) + 99) // 100 THEN low END) AS lower,
  min(CASE WHEN k = (n * tail + 99) // 100 THEN low + CASE WHEN low < 64 THEN 0 ELSE (1::BIGINT << (len(bin(low)) - 6)::BIGINT) - 1 END END) AS upper FROM q GROUP BY ALL),
e AS (SELECT level, lang, source, measure, lower - (middle - lower) * tenths // 10 AS low, upper + (upper - middle) * tenths // 10 AS high, n * (100 - tail) >= 1000 AND upper > middle AS usable FROM f),
h AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.usable THEN a.low WHEN b.usable THEN b.low ELSE c.low END AS low, CASE WHEN a.usable THEN a.high WHEN b.usable THEN b.high ELSE c.high END AS high
  FROM e a JOIN e b ON b.level = 1 AND a.measure = b.measure AND a.lang IS NOT DISTINCT FROM b.lang JOIN e c ON c.level = 2 AND a.measure = c.measure WHERE a.level = 0),
v AS (SELECT rid, bool_and(value <= high AND (r.measure <> 'mean_length' OR value >= low)) AS inside
  FROM r JOIN h ON r.measure = h.measure AND r.lang IS NOT DISTINCT FROM h.lang AND r.source IS NOT DISTINCT FROM h.source GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND inside, false) AS kept FROM b LEFT JOIN v USING (rid)
"""

OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to, true AS has_request, true AS has_metadata
FROM p LEFT JOIN f USING (payload_digest)
"""

# Each turn a shard takes the first slot of its preference order that is still free.
OP3 = f"""
WITH RECURSIVE s AS (
  SELECT k, ('0x' || left(md5('offset:shard-' || k), 15))::BIGINT % {SLOTS} AS start, ('0x' || left(md5('step:shard-' || k), 15))::BIGINT % {SLOTS - 1} + 1 AS step FROM range({SHARDS}) r(k)),
prefers AS MATERIALIZED (SELECT k, list_transform(range({SLOTS}), lambda j: (start + j * step) % {SLOTS}) AS slots FROM s),
fill AS (
  SELECT 0::BIGINT AS turn, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner
  UNION ALL
  SELECT turn + 1, owner[1:pick] || [turn % {SHARDS}] || owner[pick + 2:]
  FROM (SELECT turn, owner, list_filter(slots, lambda x: owner[x + 1] < 0)[1] AS pick FROM fill JOIN prefers ON k = turn % {SHARDS} WHERE turn < {SLOTS})),
filled AS (SELECT owner FROM fill WHERE turn = {SLOTS})
SELECT doc_id, slot::INTEGER AS slot, owner[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT % {SLOTS} AS slot FROM documents), filled
"""

_bounds = f"t.n * {200 - THRESHOLD} >= u.n * {THRESHOLD} AND u.n * {200 - THRESHOLD} >= t.n * {THRESHOLD}"
_quoted = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in TEMPLATES)
_grams = lambda words: f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"
OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '(?im)^[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|©)[^\n]*', '', 'g'), '(?m)^[^\p{{L}}\p{{N}}\n]*(?:[0-9]{{1,2}}|[a-z])[.)][ \t]+', '', 'g')), 'licenc', 'licens') AS text FROM documents),
lines AS (SELECT rid, doc_id, 'line' AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no, unnest(string_split(text, chr(10))) AS passage FROM d),
paragraphs AS (SELECT rid, doc_id, 'paragraph' AS unit, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) - 1 AS unit_no, unnest(regexp_split_to_array(text, '\n\s*\n')) AS passage FROM d),
units AS (
  SELECT * FROM lines UNION ALL SELECT * FROM paragraphs WHERE contains(trim(passage, ' '), chr(10))
  UNION ALL SELECT rid, doc_id, 'text', 0, text FROM d WHERE regexp_matches(text, '\S\s*\n\s*\n\s*\S')),
w AS (SELECT row_number() OVER () AS uid, doc_id, unit, unit_no::BIGINT AS unit_no, regexp_extract_all(passage, '[\p{{L}}\p{{N}}]+') AS words FROM units),
u AS (SELECT *, len(b)::BIGINT AS n FROM (SELECT uid, doc_id, unit, unit_no, {_grams("words")} AS b FROM w)),
t0(template, licence, body) AS (VALUES {_quoted}),
tw AS (SELECT template, licence, regexp_extract_all(replace(lower(body), 'licenc', 'licens'), '[\p{{L}}\p{{N}}]+') AS words FROM t0),
t AS (SELECT *, len(b)::BIGINT AS n FROM (SELECT template, licence, {_grams("words")} AS b FROM tw)),
c AS (SELECT uid, doc_id, unit, unit_no, template, licence, u.n AS n_bigrams, len(list_intersect(u.b, t.b))::BIGINT AS n_common, t.n FROM u JOIN t ON {_bounds}),
h AS (SELECT *, round(n_common * 2.0::DOUBLE / (n_bigrams + n), 6) AS dice FROM c WHERE n_common * 200 >= (n_bigrams + n) * {THRESHOLD})
SELECT doc_id, unit, unit_no, template, licence, n_bigrams, n_common, dice FROM h QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, template) = 1
"""
