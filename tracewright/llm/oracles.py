"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

MIXING = r"""
WITH d AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), l AS (
  SELECT *,
    (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
    row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS place
  FROM w
), f AS (
  SELECT arg_min(level, place) AS level FROM l WHERE source_size * 2::DOUBLE >= weight * level
), t AS (
  SELECT source, source_size, least(source_size * 2::DOUBLE, coalesce(weight * f.level, 'inf'::DOUBLE)) AS target FROM w LEFT JOIN f ON true
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT *, CASE WHEN whole < 2 THEN target - whole * source_size ELSE 0 END AS rest FROM k
), h AS (
  SELECT source, hash, sum(size)::BIGINT AS tokens FROM d GROUP BY source, hash
), c AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h
), e AS (
  SELECT c.source, arg_max(c.hash, c.hash) AS hash, arg_max(c.before, c.hash) AS before, arg_max(c.tokens, c.hash) AS tokens
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE c.before <= r.rest GROUP BY c.source
), x AS (
  SELECT r.*, CASE WHEN rest <= 0 THEN -1 WHEN e.before + e.tokens / 2 <= rest THEN e.hash ELSE e.hash - 1 END AS last
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
)
SELECT d.doc_id, d.source, d.size, x.source_size, x.target,
  (d.size * (x.whole + CASE WHEN d.hash <= x.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

CHAT = r"""
WITH raw AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM raw
), m AS (
  SELECT *, (len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]')) + 8)::BIGINT AS tok,
    length(role) + length(text)
      + 2 * length(text) - 2 * length(replace(text, '\', '')) - (length(text) - length(replace(text, '\', '')))
      + 2 * length(role) - 2 * length(replace(role, '\', '')) - (length(role) - length(replace(role, '\', '')))
      + length(role) - length(replace(role, ':', ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(role) - length(replace(role, '</turn>', ''))) // 7
      + coalesce(list_sum([greatest(length(x) - 2, 0) for x in regexp_extract_all(text, '#+')]), 0)
      + coalesce(list_sum([greatest(length(x) - 2, 0) for x in regexp_extract_all(role, '#+')]), 0)
      + 15 AS chars
  FROM r
), o AS (
  SELECT *, row_number() OVER w - 1 AS ord,
    coalesce(sum(tok) OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto
  FROM m WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT c, min(ord) AS sord, arg_min(tok, ord) AS stok, arg_min(chars, ord) AS schars FROM o WHERE role = 'system' GROUP BY c
), t AS (
  SELECT o.*, sord, greatest(0, 1024 - coalesce(stok, 0)) AS free FROM o LEFT JOIN s ON o.c IS NOT DISTINCT FROM s.c
), v AS (
  SELECT *, greatest(1, free - least(128, free // 2)) AS room FROM t
), l AS (
  SELECT *, upto // room AS cell, (upto + tok - 1) // room > upto // room AS across FROM v
), w AS (
  SELECT c, cell, across, min(ord) AS win, min(upto) AS start, bool_or(ord = sord) AS holds,
    least(128, max(free) - sum(tok) + coalesce(max(CASE WHEN ord = sord THEN tok END), 0)) AS spare FROM l GROUP BY c, cell, across
), extra AS (
  SELECT w.c, sum(l.chars) AS chars FROM l JOIN w ON l.c IS NOT DISTINCT FROM w.c
    AND w.start >= l.upto + l.tok AND w.spare > 0 AND w.start <= l.upto + w.spare
  WHERE l.ord IS DISTINCT FROM l.sord GROUP BY w.c
), heads AS (
  SELECT w.c, sum(schars) AS chars FROM w JOIN s ON w.c IS NOT DISTINCT FROM s.c WHERE NOT coalesce(holds, false) GROUP BY w.c
), g AS (
  SELECT c, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord) AS said,
    coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '') AS learnt, sum(chars) AS chars
  FROM o GROUP BY c
)
SELECT g.c AS conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
  sha256(learnt) AS loss_sha256, (g.chars + coalesce(extra.chars, 0) + coalesce(heads.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN extra ON g.c IS NOT DISTINCT FROM extra.c LEFT JOIN heads ON g.c IS NOT DISTINCT FROM heads.c
"""

EMBEDDINGS = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND list_count(v) = len(v)
    AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98::DOUBLE
), r AS (
  SELECT vec_id AS id, vec_id AS low FROM e
  UNION
  SELECT p.b, r.low FROM r JOIN p ON r.id = p.a WHERE r.low < p.b
), c AS (
  SELECT id, min(low) AS component_id FROM r GROUP BY id
), k AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON e.vec_id = c.id LEFT JOIN k ON e.vec_id = k.a
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), r AS (
  SELECT lang, source, term, count(*) AS n, any_value(n_lang) AS n_lang FROM w JOIN k USING (lang, term) GROUP BY lang, source, term
), l AS (
  SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang
), s AS (
  SELECT lang, source, sum(n) AS total FROM r GROUP BY lang, source
), g AS (
  SELECT DISTINCT d.lang, d.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, total_lang
  FROM d LEFT JOIN l ON d.lang = l.lang LEFT JOIN s ON d.lang = s.lang AND d.source = s.source
), p AS (
  SELECT g.lang, g.source, k.term, r.n, 1 + 1000000000::HUGEINT * (coalesce(r.n, 0) + 2) // (g.total + 2 * g.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.n_lang + 2) // (g.total_lang + 2 * g.v)::HUGEINT AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN r ON r.lang = g.lang AND r.source = g.source AND r.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o
)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10
"""

REPEATS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT r, unnest(range(1, len(ws) + 1)) AS j, ws FROM d
), q AS (
  SELECT r, j, ws[j] AS word, CASE WHEN j + 34 <= len(ws) THEN sha256(array_to_string(list_slice(ws, j, j + 34), ' ')) END AS win FROM p
), c AS (
  SELECT win, count(*) AS n FROM q WHERE win IS NOT NULL GROUP BY win
), f AS (
  SELECT r, j, word, coalesce(max(n) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 1 AS gone
  FROM q LEFT JOIN c USING (win)
), g AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM f GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
