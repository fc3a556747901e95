"""SQL (DuckDB) for the rows of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT DISTINCT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON r.t = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.t) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id
"""

_ENTRY = "'<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10)"

PREFERENCE_FORMAT = f"""
WITH last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
b AS (SELECT c.conv_id, c.role, CASE WHEN c.role = 'assistant' AND c.turn = l.last_turn THEN coalesce(o.answer, '') ELSE c.text END AS text,
  row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role) AS pos
  FROM conversations c LEFT JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = c.conv_id + 1),
k AS (SELECT a.conv_id, coalesce(min(a.pos) FILTER (WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) - 1, max(a.pos)) AS n_common
  FROM a JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos GROUP BY a.conv_id),
t AS (SELECT 'a' AS side, a.*, n_common, {_ENTRY} AS entry FROM a JOIN k USING (conv_id) UNION ALL SELECT 'b', b.*, n_common, {_ENTRY} FROM b JOIN k USING (conv_id)),
m AS (SELECT *, coalesce(sum(length(entry)) OVER (PARTITION BY side, conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM t WHERE pos > n_common),
c AS (SELECT side, conv_id, string_agg(entry, '' ORDER BY pos) AS text,
  string_agg(CAST(start + 5 + length(role) AS BIGINT) || '-' || CAST(start + length(entry) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE role = 'assistant') AS mask FROM m GROUP BY side, conv_id),
q AS (SELECT conv_id, string_agg(entry, '' ORDER BY pos) AS prompt FROM t WHERE side = 'a' AND pos <= n_common GROUP BY conv_id)
SELECT k.conv_id, k.n_common, coalesce(q.prompt, '') AS prompt, coalesce(x.text, '') AS chosen, coalesce(x.mask, '') AS chosen_mask, coalesce(y.text, '') AS rejected, coalesce(y.mask, '') AS rejected_mask
FROM k LEFT JOIN q USING (conv_id) LEFT JOIN c x ON x.side = 'a' AND x.conv_id = k.conv_id LEFT JOIN c y ON y.side = 'b' AND y.conv_id = k.conv_id
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, i, w[i:i + 4] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
c AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM h) GROUP BY row),
b AS (SELECT row, doc_id, t, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN l USING (row) LEFT JOIN c USING (row)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
  OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > word_chars OR 10 * len(regexp_extract_all(t, '\p{{L}}')) < 4 * word_chars OR 3 * len(regexp_extract_all(t, '!')) > n_words
  OR 4 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > n_words OR coalesce(list_max(list_transform(w, lambda x: length(x))), 0) >= 300) AS kept
FROM f
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
f AS (SELECT lang, w[i:i + k - 1] AS x, count(*) AS f FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(x) = 1 GROUP BY lang),
c AS (SELECT lang, x, f AS a FROM f WHERE len(x) > 1 AND f >= 10),
k AS (SELECT c.lang, c.x, c.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(x))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.x = c.x[1:k] JOIN f r ON r.lang = c.lang AND r.x = c.x[k + 1:]),
m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
g AS (SELECT lang, x[1:2] AS x, max(a) AS a FROM c WHERE len(x) = 3 GROUP BY 1, 2 UNION ALL SELECT lang, x[2:3], max(a) FROM c WHERE len(x) = 3 GROUP BY 1, 2),
s AS (SELECT m.lang, array_to_string(m.x, ' ') AS phrase, m.a, m.l, m.r, m.score FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = m.lang AND g.x = m.x AND 100 * g.a >= 50 * m.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM s)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
b AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM d JOIN e USING (t)),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, 15 - p.k - q.k - r.k - s.k] AS o FROM x p, x q, x r, x s WHERE len(list_distinct([p.k, q.k, r.k, s.k])) = 4),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: chr(64 + i::INT)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
z AS (SELECT part, filter_order, step, o[step] AS filter, fails[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda i: fails[i]), true) AS here,
  list_contains(list_transform(o[1:step], lambda i: fails[i]), true) AS gone, fails[o[step]] AS failing, len(list_filter(fails, lambda v: v)) = 1 AS one, n, good, toxic FROM c, s),
y AS (SELECT part, filter_order, step, any_value(filter) AS filter, coalesce(sum(n) FILTER (WHERE NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE here), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE failing AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failing AND one), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE here), 0)::BIGINT AS toxic_lost FROM z GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM y
"""

ORACLES = {"op1_jaccard_join": JACCARD_JOIN, "op2_preference_format": PREFERENCE_FORMAT, "op6_quality_rules": QUALITY_RULES, "op12_collocations": COLLOCATIONS, "op13_filter_audit": FILTER_AUDIT}
