"""DuckDB SQL for the registered queries, over the same tables (views of the Parquet files)."""

from __future__ import annotations

from ..functions import scoring
from . import fixtures

E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
S = f"{E}, s AS (SELECT c.id AS cue_id, e.id, list_dot_product(c.v, e.v) AS sim FROM e AS c CROSS JOIN e WHERE c.id % 50 = 0)"
P = f"{E}, p AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS sim FROM e AS a JOIN e AS b ON a.id <> b.id)"
TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
D = f"d AS (SELECT *, {TRIM.format('text')} AS t FROM documents)"


def _any(col: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(col, p.replace("'", "''")) for p in parts) + ")"


WORDS = r"len(regexp_extract_all({0}, '\S+'))"
# Numbers with Unicode-aware word boundaries: words with a letter go first, then runs of digits joined by marks count.
NUMBERS = r"len(regexp_extract_all(regexp_replace({0}, '[\p{{L}}\p{{N}}_]*[\p{{L}}_][\p{{L}}\p{{N}}_]*', 'x', 'g'), '[0-9]+(?:[.,]+[0-9]+)*'))"
PRIOR = (
    "CASE WHEN t = '' THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(10.0::DOUBLE, 3.0::DOUBLE "
    "+ (CASE WHEN n >= 40 THEN 1.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN n >= 120 THEN 1.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN n < 20 THEN -1.5 ELSE 0.0 END)::DOUBLE "
    "+ (CASE WHEN k >= 1 THEN 0.7 ELSE 0.0 END)::DOUBLE + (CASE WHEN k >= 3 THEN 0.6 ELSE 0.0 END)::DOUBLE "
    f"+ (CASE WHEN {_any('lower(t)', scoring.CONTRAST)} THEN 0.8 ELSE 0.0 END)::DOUBLE + (CASE WHEN {_any('lower(t)', scoring.HUMAN)} THEN 0.6 ELSE 0.0 END)::DOUBLE "
    "+ (CASE WHEN length(t) - length(replace(replace(t, '.', ''), chr(10), '')) <= 1 AND n < 30 THEN -1.0 ELSE 0.0 END)::DOUBLE)) END"
)
SUB = f"{D}, w AS (SELECT *, {WORDS.format('t')} AS n, {NUMBERS.format('t')} AS k FROM d), x AS (SELECT *, {PRIOR} AS prior FROM w)"
LABELLED = f"{SUB}, l AS (SELECT x.*, quality, toxic FROM x LEFT JOIN labels USING (doc_id))"
SALIENCE = (
    "greatest(1.0::DOUBLE, least(10.0::DOUBLE, round_even("
    "(CASE WHEN quality IS NULL THEN prior WHEN quality = 1 THEN least(9.0::DOUBLE, 1.0::DOUBLE + 9.0::DOUBLE * (quality + 1 - toxic) / 2 + 0.5::DOUBLE) "
    "ELSE 1.0::DOUBLE + 9.0::DOUBLE * (quality + 1 - toxic) / 2 END) - (CASE WHEN n < 40 THEN 2.0 ELSE 0.0 END)::DOUBLE, 1)))"
)
LAW = "CASE WHEN quality IS NULL THEN 'unscored' ELSE (quality + 1 - toxic)::VARCHAR || '/2' END"
MONEY = "(?i)(" + scoring.MONEY.replace("'", "''") + ")"
FAMILY, HEALTH, FINANCE, STRONG = (_any("lower({0})", x) for x in (scoring.FAMILY, scoring.HEALTH, scoring.FINANCE, scoring.STRONG_HEALTH))
WHY = (
    f"CASE WHEN regexp_matches(s, '{MONEY}') THEN 'money' WHEN {FAMILY.format('s')} AND {HEALTH.format('s')} THEN 'family+health' "
    f"WHEN {FAMILY.format('s')} AND {FINANCE.format('s')} THEN 'family+finance' WHEN {STRONG.format('s')} THEN 'health' END"
)
BOUND = f"b AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {fixtures.sql_values('boundary')}) v(doc_id, text))"


def _split(col: str) -> str:
    """List of sentences: breaks are marked first, as there is no look-behind."""
    marked = rf"regexp_replace(regexp_replace({TRIM.format(col)}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {TRIM.format('x')}), lambda x: x <> '')"


def _weights(form: str) -> str:
    return f"""WITH {S}, z AS (
  SELECT cue_id, id, (sim * 12.0::DOUBLE - max(sim * 12.0::DOUBLE) OVER (PARTITION BY cue_id)) * {0.5 if form == 'entmax' else 1.0}::DOUBLE AS z FROM s
), r AS (
  SELECT *, row_number() OVER o AS k, avg(z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m,
    avg(z * z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q, sum(z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM z WINDOW o AS (PARTITION BY cue_id ORDER BY z DESC, id)
), t AS (
  SELECT *, {'m - sqrt(greatest((1 - k * (q - m * m)) / k, 0))' if form == 'entmax' else '(c - 1) / k'} AS t FROM r
), u AS (
  SELECT *, max(CASE WHEN t {'<=' if form == 'entmax' else '<'} z THEN k END) OVER (PARTITION BY cue_id) AS kk FROM t
), w AS (
  SELECT *, {'pow(' if form == 'entmax' else '('}greatest(z - max(CASE WHEN k = kk THEN t END) OVER (PARTITION BY cue_id), 0){', 2)' if form == 'entmax' else ')'} AS w FROM u
)"""


PRIORS = """h AS (
  SELECT cue_id, id, w, id % 365 AS day, CASE WHEN id % 11 > 0 THEN (id % 11)::DOUBLE / 10 ELSE 0.5::DOUBLE END AS sal, 0.8::DOUBLE + label * 0.05::DOUBLE AS cw
  FROM w JOIN e USING (id)
), g AS (
  SELECT *, (day - min(day) OVER ())::DOUBLE / greatest(1, max(day) OVER () - min(day) OVER ()) AS rec, (cw - min(cw) OVER ()) / (max(cw) OVER () - min(cw) OVER ()) AS cha FROM h
), f AS (SELECT *, w + 0.1::DOUBLE * rec + 0.1::DOUBLE * sal + 0.1::DOUBLE * cha AS base FROM g)"""


def _mmr(base: str) -> str:
    """Three picks, unrolled: base is a relation (cue_id, id, base); e holds the vectors."""
    return f"""p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY base DESC, id) AS rn FROM {base} WHERE base > 0.001) WHERE rn = 1
), c2 AS (
  SELECT b.cue_id, b.id, b.base, list_dot_product(x.v, y.v) AS near FROM {base} b JOIN p1 USING (cue_id) JOIN e x ON x.id = b.id JOIN e y ON y.id = p1.id WHERE b.id <> p1.id AND b.base > 0.001
), p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY 0.5::DOUBLE * base - 0.5::DOUBLE * near DESC, id) AS rn FROM c2) WHERE rn = 1
), c3 AS (
  SELECT c.cue_id, c.id, c.base, greatest(c.near, list_dot_product(x.v, y.v)) AS near FROM c2 c JOIN p2 USING (cue_id) JOIN e x ON x.id = c.id JOIN e y ON y.id = p2.id WHERE c.id <> p2.id
), p3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY 0.5::DOUBLE * base - 0.5::DOUBLE * near DESC, id) AS rn FROM c3) WHERE rn = 1
), picks AS (SELECT cue_id, 1 AS pos, id, base FROM p1 UNION ALL SELECT cue_id, 2, id, base FROM p2 UNION ALL SELECT cue_id, 3, id, base FROM p3)"""


GAP = f"WITH {P}, t AS (SELECT i, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC) AS rn FROM p), g AS (SELECT i, max(CASE WHEN rn = 1 THEN sim END) - max(CASE WHEN rn = 2 THEN sim END) AS gap FROM t WHERE rn <= 2 GROUP BY i), q AS (SELECT count(*) AS n, avg(gap) AS gap FROM g)"
SEPARATE = f"""WITH {P}, z AS (SELECT i, j, (sim * 12.0::DOUBLE - max(sim * 12.0::DOUBLE) OVER (PARTITION BY i)) * 0.5::DOUBLE AS z FROM p
), r AS (
  SELECT *, row_number() OVER o AS k, avg(z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, avg(z * z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q
  FROM z WHERE z > -1 WINDOW o AS (PARTITION BY i ORDER BY z DESC, j)
), t AS (SELECT *, m - sqrt(greatest((1 - k * (q - m * m)) / k, 0)) AS t FROM r
), u AS (SELECT *, max(CASE WHEN t <= z THEN k END) OVER (PARTITION BY i) AS kk FROM t
), w AS (SELECT i, pow(greatest(z - max(CASE WHEN k = kk THEN t END) OVER (PARTITION BY i), 0), 2) AS w FROM u
), a AS (SELECT i AS id, max(w) AS top, count(*) FILTER (WHERE w > 0.001) AS active FROM w GROUP BY i)"""
CENTER = f"{E}, m AS (SELECT pos, avg(x) AS x FROM (SELECT generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM e WHERE label = 0) GROUP BY pos), c AS (SELECT list(x ORDER BY pos) AS m FROM m), n AS (SELECT list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM c)"
SCORES = f"{CENTER}, k AS (SELECT e.id, label, 1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(e.v, n.c))) AS s FROM e CROSS JOIN n)"
MODEL = f"""{SCORES}, cal AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM k WHERE label = 0
), mo AS (
  SELECT max(n) AS n, coalesce(max(CASE WHEN rn = ceil((n + 1)::DOUBLE * 0.9::DOUBLE) THEN s END), 'inf'::DOUBLE) AS q, max(CASE WHEN rn = ceil(n::DOUBLE * 0.9::DOUBLE) THEN s END) AS c FROM cal
), model AS (
  SELECT mo.n, mo.q, CASE WHEN mo.n < 3 OR ceil(mo.n::DOUBLE * 0.9::DOUBLE) > mo.n - 1 THEN 1.0::DOUBLE ELSE (SELECT count(*) FROM cal WHERE cal.s <= mo.c)::DOUBLE / mo.n END AS coverage FROM mo
)"""
SIGNALS = """g AS (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'writing' ELSE event_type END AS channel, CASE WHEN user_id % 7 <> 0 THEN value % 1.0::DOUBLE END AS weight,
    CASE WHEN user_id % 5 <> 0 THEN (value * 3) % 1.0::DOUBLE END AS score, event_id % 4 + 1 AS iterations, event_id % 3 = 1 AS smells, (value * 7) % 1.0::DOUBLE AS law, event_id % 2 = 0 AS fail FROM events
)"""
STAKES = "CASE channel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.STAKES.items()) + " ELSE 0.5 END::DOUBLE"
REVERSIBLE = "list_contains(['cheap to revert', 'slow and costly', 'kolay'], ['cheap to revert', 'high', 'slow and costly', 'kolay'][(id % 4 + 1)::INT])"

#: What each labelled document's judge said of the two items, by the shape of its output.
JUDGED = """j AS (SELECT doc_id AS draft_id, doc_id % 8 AS kind, quality = 1 AS good, toxic = 0 AS clean FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
), s AS (SELECT draft_id, kind, clean, unnest([{'key': 'quality', 'weight': 3.0::DOUBLE, 'said': CASE WHEN kind IN (5, 6, 7) THEN NULL ELSE good END},
{'key': 'clean', 'weight': 2.0::DOUBLE, 'said': CASE WHEN kind IN (5, 6) THEN NULL ELSE clean END}], recursive := true) FROM j
), k AS (SELECT draft_id, kind, CASE WHEN clean THEN 1 ELSE 0 END AS clean, key, weight, coalesce(said, false) AS pass, said IS NOT NULL AS parsed FROM s)"""

#: The documents as the entries of one notebook, and as a log of decisions.
BOOK = f"""b AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN '```' || chr(10) || '### no heading' || chr(10) || '---' || chr(10) || '```' || chr(10) ELSE '' END || coalesce(text, '') AS said FROM documents
), k AS (SELECT doc_id, source, {TRIM.format('said')} AS body, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) OVER w AS sec, last_value(CASE WHEN doc_id % 3 = 0 THEN lang END IGNORE NULLS) OVER w AS section,
CASE WHEN doc_id % 7 = 0 THEN '### A. skipped' ELSE '### note ' || doc_id || ' — Substack (01.02.2026)' END || chr(10) || '> about ' || source || chr(10) || said || chr(10) || '---' AS block FROM b WINDOW w AS (ORDER BY doc_id))"""
LOG = """c AS (SELECT doc_id, source AS project, CASE WHEN doc_id % 2 = 0 THEN '2026-01-05 · build · pick ' || doc_id ELSE 'use ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'pick ' ELSE 'add ' END || doc_id AS choice,
CASE WHEN doc_id % 2 = 1 THEN lang WHEN doc_id % 4 = 0 THEN 'because ' || lang || ' it fits' ELSE 'because ' || lang || ' it fits free words, no label' END AS reason,
CASE WHEN doc_id % 2 = 1 THEN 'high' WHEN doc_id % 4 = 0 THEN 'ucuz' ELSE '' END AS cost, CASE WHEN doc_id % 2 = 1 THEN 'slow.' ELSE 'it waits' END AS context, '' AS outcome,
CASE WHEN doc_id % 2 = 0 THEN '2026-01-05' ELSE '2026-02-03' END AS date FROM documents)"""

#: The items of each document's rubric.
RUBRICS = """i AS (SELECT doc_id AS rubric_id, 0 AS place, 'speak_of_' || doc_id AS key, 'Speak of ' || doc_id || '.' AS title, 'In ' || lang || ' and no other.' AS "desc", 'backbone' AS kind, 1.0::DOUBLE AS weight FROM documents
UNION ALL SELECT doc_id, 1, 'stay_with_' || trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), 'Stay with — ' || source || '.', 'Keep: to it.', 'backbone', 1.0 FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 2, 'no_list', 'No list.', 'No list.', 'mechanical', 2.5 FROM documents)"""

ORACLES: dict[str, str] = {
    "rubric_items": f"""WITH {RUBRICS} SELECT rubric_id, (row_number() OVER (PARTITION BY rubric_id ORDER BY place) - 1)::INT AS ord, key, title, "desc", kind, weight FROM i""",
    "rubric_weight": f"WITH {RUBRICS} SELECT rubric_id, sum(weight) AS total_weight FROM i GROUP BY rubric_id",
    "prompt_law": """SELECT doc_id AS rubric_id, 'THE RUBRIC (keep every item):' || chr(10) || '- Speak of ' || doc_id || '. In ' || lang || ' and no other.' || chr(10)
|| CASE WHEN doc_id % 2 = 0 THEN '- Stay with. ' || source || '. Keep. to it.' || chr(10) ELSE '' END || '- No list. No list.' AS text FROM documents""",
    "law_desc": """SELECT l.doc_id AS rubric_id, CASE WHEN toxic = 1 THEN 'no_list' WHEN quality = 0 THEN 'speak_of_' || l.doc_id ELSE 'unheard_of' END AS key,
CASE WHEN toxic = 1 THEN 'No list.' WHEN quality = 0 THEN 'In ' || lang || ' and no other.' ELSE 'unheard_of' END AS "desc" FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "markdown_entries": f"""WITH {BOOK} SELECT 'all/2026-01-05-notes.md' AS path, 'note ' || doc_id || ' — Substack (01.02.2026)' AS title, sha1(body) AS body, section, 'about ' || source AS note, 'Substack' AS channel, '01.02.2026' AS date
FROM k WHERE doc_id % 7 <> 0 AND body <> ''""",
    "markdown_sections": f"""WITH {BOOK}, g AS (SELECT sec, max(section) AS lang, string_agg(block, chr(10) ORDER BY doc_id) AS body FROM k GROUP BY sec), t AS (SELECT lang, {TRIM.format('body')} AS body FROM g)
SELECT 'all/2026-01-05-notes.md' AS path, 'Notes — ' || lang AS title, length(body)::BIGINT AS n, sha1(body) AS body, 'Notes' AS section, '2026-01-05' AS date FROM t WHERE length(body) >= 40""",
    "decision_fields": f"WITH {LOG} SELECT title, choice, reason, cost, context, outcome, date, project FROM c",
    "decision_memory": f"""WITH {LOG} SELECT title, concat_ws(chr(10), 'durum: ' || context, 'karar: ' || choice, 'neden: ' || reason, CASE WHEN cost <> '' THEN 'geri alma: ' || cost END) AS body, 'decision:' || project AS source,
CASE WHEN cost <> '' THEN 'reversal-cost: ' || cost ELSE '' END AS note FROM c""",
    "decision_stats": f"WITH {LOG} SELECT project, count(*)::BIGINT AS n, count(*)::BIGINT AS \"full\", sum(CASE WHEN cost <> '' THEN 1 ELSE 0 END)::BIGINT AS costed, count(*)::BIGINT AS placed FROM c GROUP BY project",
    "channel_counts": "SELECT source AS channel, count(*) AS n FROM documents GROUP BY source",
    "min_body_filter": f"WITH {D} SELECT doc_id, length(t)::BIGINT AS n FROM d WHERE length(t) >= 30",
    "cap_body": r"WITH c AS (SELECT doc_id, length(text) > 4000 AS capped, CASE WHEN length(text) > 4000 THEN regexp_replace(substr(text, 1, 4000), ' [^ ]*$', '') || ' …' ELSE text END AS b FROM documents) SELECT doc_id, length(b)::BIGINT AS n, capped, sha1(b) AS body_sha1 FROM c",
    "registry_load": rf"""WITH a AS (SELECT doc_id, text, 'writing' AS channel, source AS subchannel, 1.0::DOUBLE AS channel_weight FROM documents UNION ALL SELECT item_id, text, 'idea', '', 1.1::DOUBLE FROM benchmark)
SELECT doc_id, channel, subchannel, channel_weight, length(CASE WHEN length(text) > 4000 THEN regexp_replace(substr(text, 1, 4000), ' [^ ]*$', '') || ' …' ELSE text END)::BIGINT AS n FROM a WHERE length({TRIM.format('text')}) >= 30""",
    "body_stats": "SELECT min(length(text))::BIGINT AS least, round(quantile_cont(length(text), 0.5), 3)::DOUBLE AS median, max(length(text))::BIGINT AS most FROM documents",
    "dedup_first": f"WITH {D} SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM d GROUP BY lower(t)",
    "text_sha1": "SELECT doc_id, sha1(text) AS sha FROM documents",
    "cache_misses": "SELECT DISTINCT sha1(text) AS text_sha1 FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
    "infer_title": rf"WITH {D}, l AS (SELECT doc_id, {TRIM.format(chr(114) + 'egexp_replace(string_split(t, chr(10))[1], ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS l FROM d) SELECT doc_id, CASE WHEN l = '' THEN 'untitled' WHEN length(l) > 70 THEN substr(l, 1, 70) || '…' ELSE l END AS title FROM l",
    "sanitize": rf"""WITH a AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {fixtures.sql_values('sanitize')}) v(doc_id, text)), b AS (
SELECT doc_id, {TRIM.format("regexp_replace(regexp_replace(replace(replace(text, ' — ', '. '), '—', '. '), ':" + chr(92) + "s+', '. ', 'g'), '[." + chr(92) + "s]*" + chr(92) + ".[." + chr(92) + "s]*" + chr(92) + ".[." + chr(92) + "s]*', '. ', 'g')")} AS t FROM a) SELECT doc_id, length(t)::BIGINT AS n, sha1(t) AS sha FROM b""",
    "substance_prior": f"WITH {SUB} SELECT doc_id, round(prior, 3) AS prior FROM x",
    "salience": f"WITH {LABELLED} SELECT doc_id, {SALIENCE} AS salience, {LAW} AS law_pass FROM l",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_split('text')} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, sha1(array_to_string(s, '|')) AS sha FROM s",
    "structural_flags": f"WITH {BOUND}, s AS (SELECT doc_id, unnest({_split('text')}) AS s FROM b) SELECT doc_id, coalesce({WHY}, 'none') AS why, count(*) AS n FROM s GROUP BY ALL",
    "trace_sensitivity": f"WITH {BOUND} SELECT doc_id, doc_id = -8 OR ({FAMILY.format('text')} AND ({HEALTH.format('text')} OR regexp_matches(lower(text), '{MONEY}'))) AS sensitive FROM b",
    "cosine_to_cue": f"WITH {S} SELECT cue_id, id, round(sim, 6) AS sim FROM s",
    "topk_similar": f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY sim DESC, id) AS rn FROM s) SELECT cue_id, id, round(sim, 6) AS sim FROM r WHERE rn <= 4",
    "softmax_weights": f"WITH {S}, x AS (SELECT *, exp(12.0::DOUBLE * sim - max(12.0::DOUBLE * sim) OVER (PARTITION BY cue_id)) AS x FROM s) SELECT cue_id, id, round(x / sum(x) OVER (PARTITION BY cue_id), 6) AS w FROM x",
    "entmax15_weights": _weights("entmax") + " SELECT cue_id, id, round(w, 6) AS w FROM w",
    "sparsemax_weights": _weights("sparsemax") + " SELECT cue_id, id, round(w, 6) AS w FROM w",
    "active_traces": _weights("entmax") + " SELECT cue_id, count(*) FILTER (WHERE w > 0.001) AS active FROM w GROUP BY cue_id",
    "recall_base_score": f"{_weights('entmax')}, {PRIORS} SELECT cue_id, id, round(base, 6) AS base, round(rec, 6) AS recency, round(cha, 6) AS channel_prior FROM f",
    "recall_topk": f"""{_weights('entmax')}, {PRIORS}, {_mmr('f')}
SELECT picks.cue_id, pos, picks.id, round(f.w, 6) AS w, round(s.sim, 6) AS sim, round(picks.base, 6) AS score, n AS active FROM picks JOIN f ON picks.cue_id = f.cue_id AND picks.id = f.id
JOIN s ON picks.cue_id = s.cue_id AND picks.id = s.id JOIN (SELECT cue_id, count(*) FILTER (WHERE w > 0.001) AS n FROM w GROUP BY cue_id) a ON picks.cue_id = a.cue_id""",
    "mmr_k3": f"WITH {S}, b AS (SELECT cue_id, id, sim AS base FROM s), {_mmr('b')} SELECT cue_id, pos, id, round(base, 6) AS base FROM picks",
    "beta_calibration": f"{GAP} SELECT n, round(gap, 6) AS gap, round(CASE WHEN n < 2 THEN 12 WHEN gap < 1e-4 THEN 20 ELSE least(40, greatest(4, ln(6.0::DOUBLE) / gap)) END::DOUBLE, 6) AS beta FROM q",
    "dynamic_alpha": f"{GAP} SELECT round(1.5::DOUBLE + greatest(0, least(1, 1 - gap / 0.3::DOUBLE)) * 0.5::DOUBLE, 6) AS alpha FROM q",
    "separability": f"{SEPARATE} SELECT id, round(top, 6) AS top, active FROM a",
    "separability_report": f"{SEPARATE} SELECT round(avg(top), 6) AS mean_top_mass, round(avg(active), 6) AS mean_active, count(*) FILTER (WHERE top < 0.65::DOUBLE) AS collisions FROM a",
    "hopfield_energy": f"WITH {S}, m AS (SELECT *, max(sim) OVER (PARTITION BY cue_id) AS m FROM s), t AS (SELECT cue_id, max(m) AS m, sum(exp(12.0::DOUBLE * (sim - m))) AS t FROM m GROUP BY cue_id) SELECT cue_id, round(-(m + ln(t) / 12.0::DOUBLE) + list_dot_product(v, v) / 2, 6) AS energy FROM t JOIN e ON e.id = t.cue_id",
    "pair_auc": f"WITH {E}, p AS (SELECT list_dot_product(a.v, b.v) AS sim, a.label = b.label AS same, a.id AS i, b.id AS j FROM e AS a JOIN e AS b ON a.id < b.id), r AS (SELECT same, row_number() OVER (ORDER BY sim, i, j) AS rn FROM p), t AS (SELECT sum(CASE WHEN same THEN rn END)::DOUBLE AS r, count(*) FILTER (WHERE same)::DOUBLE AS p, count(*) FILTER (WHERE NOT same)::DOUBLE AS q FROM r) SELECT round((r - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t",
    "centroid": f"WITH {CENTER} SELECT (generate_subscripts(c, 1) - 1)::BIGINT AS pos, round(unnest(c), 6) AS x FROM n",
    "conformal_quantile": f"WITH {MODEL} SELECT n, round(q, 6) AS q, round(coverage, 6) AS coverage FROM model",
    "conformal_pvalue": f"WITH {MODEL} SELECT k.id, round(k.s, 6) AS s, k.s <= model.q AS inside, round((1 + (SELECT count(*) FROM cal WHERE cal.s >= k.s))::DOUBLE / (model.n + 1), 6) AS p FROM k CROSS JOIN model WHERE label <> 0",
    "group_ids": "WITH g AS (SELECT source, lang, count(*) AS members FROM documents GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY source, lang) - 1 AS gid FROM g) SELECT doc_id, gid, members FROM documents JOIN r USING (source, lang)",
    "split_train_test": "SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 20 AS test FROM documents",
    "knn_loo": f"WITH {P}, r AS (SELECT i, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC) AS rn FROM p) SELECT i AS id, round(avg(sim), 6) AS proximity FROM r WHERE rn <= 3 GROUP BY i",
    "precedent_counts": f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY sim DESC, id) AS rn FROM s) SELECT cue_id, count(*) AS n_comparable, count(*) FILTER (WHERE {REVERSIBLE}) AS n_reversible FROM r WHERE rn <= 4 AND sim >= 0.25::DOUBLE GROUP BY cue_id",
    "world_model": f"""WITH {S}, kn AS (SELECT a.id AS i, list_dot_product(a.v, b.v) AS sim FROM e AS a JOIN e AS b ON a.id <> b.id
), kr AS (SELECT i, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC) AS rn FROM kn
), ks AS (SELECT i, 1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(sim))) AS s FROM kr WHERE rn <= 3 GROUP BY i
), cal AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM ks
), mo AS (SELECT max(n) AS n, coalesce(max(CASE WHEN rn = ceil((n + 1)::DOUBLE * 0.9::DOUBLE) THEN s END), 'inf'::DOUBLE) AS q FROM cal
), r AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY sim DESC, id) AS rn FROM s
), x AS (SELECT cue_id, avg(sim) FILTER (WHERE rn <= 3) AS proximity, count(*) FILTER (WHERE rn <= 4 AND sim >= 0.25::DOUBLE) AS n_comparable, count(*) FILTER (WHERE rn <= 4 AND sim >= 0.25::DOUBLE AND {REVERSIBLE}) AS n_reversible FROM r GROUP BY cue_id
), y AS (SELECT *, 1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, proximity)) AS s FROM x)
SELECT cue_id, round(proximity, 6) AS proximity, y.s <= mo.q AS inside, round((1 + (SELECT count(*) FROM cal WHERE cal.s >= y.s))::DOUBLE / (mo.n + 1), 6) AS p, n_comparable, n_reversible, NOT (y.s <= mo.q) OR n_comparable = 0 AS abstains FROM y CROSS JOIN mo""",
    "candidate_ranking": f"WITH {E}, p AS (SELECT a.id, max(list_dot_product(a.v, b.v)) AS prox FROM e AS a JOIN e AS b ON a.label <> 0 AND b.label = 0 AND a.id + 150 >= 200 GROUP BY a.id) SELECT id, round(prox, 6) AS prox, round(0.7::DOUBLE * prox + 0.3::DOUBLE * (id % 10)::DOUBLE / 10, 6) AS score FROM p WHERE prox <= 0.92::DOUBLE ORDER BY 0.7::DOUBLE * prox + 0.3::DOUBLE * (id % 10)::DOUBLE / 10 DESC, id LIMIT 15",
    "weighted_pass_rate": "WITH i AS (SELECT doc_id AS draft_id, 3.0::DOUBLE * quality + 2.0::DOUBLE * (1 - toxic) + (1 - doc_id % 2)::DOUBLE AS got, 3 - quality - (1 - toxic) - (1 - doc_id % 2) AS n_fail FROM labels) SELECT draft_id, round(sum(got) / (6.0::DOUBLE * count(*)), 6) AS pass_rate, sum(n_fail)::BIGINT AS n_fail, round(6.0::DOUBLE * count(*) - sum(got), 6) AS weighted_fail FROM i GROUP BY draft_id",
    "route": f"""WITH {SIGNALS}, f AS (SELECT *, 0.65::DOUBLE * coalesce(weight, 0) + 0.35::DOUBLE * least(1, coalesce(score, 0) / 0.6::DOUBLE) AS fam, {STAKES} AS stakes FROM g), h AS (SELECT *, fam >= 0.6::DOUBLE AND stakes < 0.7::DOUBLE AS fast FROM f)
SELECT event_id, CASE WHEN fast THEN 'fast' ELSE 'slow' END AS path, CASE WHEN fast THEN 2 WHEN fam < 0.4::DOUBLE OR stakes >= 0.85::DOUBLE THEN 5 ELSE 4 END::BIGINT AS max_iter, CASE WHEN fast THEN 3 ELSE 5 END::BIGINT AS k,
round(CASE WHEN fast THEN 0.45 ELSE 0.45::DOUBLE + 0.15::DOUBLE * stakes END::DOUBLE, 6) AS abstain_floor, round(CASE WHEN fast THEN 0.78 ELSE 0.78::DOUBLE + 0.07::DOUBLE * stakes END::DOUBLE, 6) AS sure_bar, round(fam, 6) AS familiarity FROM h""",
    "assess_confidence": f"""WITH {SIGNALS}, c AS (SELECT *, coalesce(weight, 0.4::DOUBLE) AS voice, CASE WHEN score IS NULL THEN 0.5 ELSE least(1.0::DOUBLE, score / 0.5::DOUBLE) END::DOUBLE AS ground, 1.0::DOUBLE - greatest(0, iterations - 1)::DOUBLE / 4 AS effort FROM g
), b AS (SELECT *, 0.45::DOUBLE * law + 0.22::DOUBLE * voice + 0.18::DOUBLE * ground + 0.15::DOUBLE * effort AS x FROM c
), s AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN x WHEN smells THEN least(1.0::DOUBLE, x + 0.03::DOUBLE) ELSE greatest(0.0::DOUBLE, x - 0.08::DOUBLE) END AS score2, least(law, voice, ground, effort) AS low FROM b)
SELECT event_id, round(score2, 6) AS score, CASE WHEN score2 < 0.45::DOUBLE THEN 'abstain' WHEN score2 >= 0.78::DOUBLE AND NOT fail THEN 'sure' ELSE 'tentative' END AS verdict,
CASE low WHEN law THEN 'law' WHEN voice THEN 'voice_fit' WHEN ground THEN 'grounding' ELSE 'effort' END AS weakest FROM s""",
    "consolidate_routing": f"""WITH {LABELLED}, r AS (SELECT doc_id AS id, t, CASE WHEN coalesce(quality = 1 AND toxic = 0, false) THEN 'gold' WHEN prior + 2 >= 8 THEN 'candidate' ELSE 'logged' END AS store FROM l)
SELECT id, store, store <> 'logged' AND id = min(id) OVER (PARTITION BY store, t) AS fresh FROM r""",
    "reflect": f"""WITH {LABELLED}, y AS (SELECT *, {TRIM.format("regexp_replace(string_split(t, chr(10))[1], '" + chr(92) + "s+', ' ', 'g')")} AS h FROM l)
SELECT doc_id, CASE WHEN h = '' THEN 'untitled' WHEN length(h) > 70 THEN substr(h, 1, 70) || '…' ELSE h END AS title, {SALIENCE} AS salience,
CASE WHEN quality IS NULL THEN 'auto-consolidated (no law verdict attached)' ELSE 'auto-consolidated, law ' || ({LAW}) || '. weakest: clean' END AS note, 'cue' AS cue, {LAW} AS law_pass FROM y""",
    "output_screen": f"""WITH {BOUND}, s AS (SELECT doc_id AS id, text, {_split('text')} AS ss FROM b), u AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS n FROM s), w AS (SELECT *, {WHY} AS why FROM u), h AS (SELECT id, list(s ORDER BY n) AS hits, string_agg(why, ',' ORDER BY n) AS reasons FROM w WHERE why IS NOT NULL GROUP BY id)
SELECT s.id, h.id IS NULL AS safe, coalesce(len(hits), 0)::BIGINT AS n_flagged, coalesce(reasons, '') AS reasons, sha1(coalesce(list_reduce(hits, lambda t, x: replace(t, x, '[sensitive: removed]'), s.text), s.text)) AS sha FROM s LEFT JOIN h USING (id)""",
    "hash_encoder": r"SELECT doc_id, 64::BIGINT AS dims, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "verdict_summary": f"""WITH {JUDGED}, c AS (SELECT draft_id, kind, sum(1)::BIGINT AS items, sum(CASE WHEN pass THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN pass THEN 0 ELSE 1 END)::BIGINT AS n_fail,
sum(CASE WHEN pass THEN 0.0 ELSE weight END)::DOUBLE AS weighted_fail, sum(CASE WHEN pass THEN weight ELSE 0.0 END)::DOUBLE / 5 AS pass_rate, max(clean) AS clean FROM k GROUP BY draft_id, kind)
SELECT draft_id, items, passed, n_fail, weighted_fail, round(pass_rate, 6) AS pass_rate, CASE WHEN kind IN (5, 7) THEN n_fail = 0 ELSE clean = 1 END AS smells, CASE WHEN kind = 5 THEN '' ELSE 'w' || kind END AS weakest FROM c""",
    "verdict_coerce": f"WITH {JUDGED} SELECT draft_id, key, pass, parsed FROM k",
    "run_loop_stub": "SELECT doc_id AS run_id, 3::INT AS round, 'Draft about note ' || doc_id || ' of ' || source AS draft, 0.0::DOUBLE AS weighted_fail FROM documents",
    "fail_counts": "SELECT doc_id AS draft_id, sum(3 - quality - (1 - toxic) - (1 - doc_id % 2))::BIGINT AS n_fail, sum(quality + (1 - toxic) + (1 - doc_id % 2))::BIGINT::VARCHAR || '/' || (3 * count(*))::VARCHAR AS law_pass FROM labels GROUP BY doc_id",
    "conformal_loo": f"""WITH {SCORES}, cal AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM k WHERE label = 0), z AS (SELECT unnest([0.05::DOUBLE, 0.2::DOUBLE]) AS eps),
mo AS (SELECT eps, max(n) AS n, max(CASE WHEN rn = ceil(n::DOUBLE * (1.0::DOUBLE - eps)) THEN s END) AS c, ceil(max(n)::DOUBLE * (1.0::DOUBLE - eps)) AS k2 FROM cal CROSS JOIN z GROUP BY eps)
SELECT eps, round(CASE WHEN n < 3 OR k2 > n - 1 THEN 1.0::DOUBLE ELSE (SELECT count(*) FROM cal WHERE cal.s <= mo.c)::DOUBLE / n END, 6) AS coverage FROM mo""",
    "context_block": f"WITH {BOUND} SELECT source AS cue_id, sha1(string_agg('--- sample ---' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS sha FROM documents WHERE NOT ({FAMILY.format('text')} AND ({HEALTH.format('text')} OR regexp_matches(lower(text), '{MONEY}'))) GROUP BY source",
    "weak_parse": """SELECT 'draft' AS kind, doc_id AS id, doc_id % 8 NOT IN (2, 5) AS readable, NULL::BIGINT AS k, CASE WHEN doc_id % 8 NOT IN (2, 5) THEN ' w' || (doc_id % 8) || ' ' END AS weakest
FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
UNION ALL SELECT 'event', event_id, props IS NOT NULL AND json_valid(props), CASE WHEN json_valid(props) THEN (props::JSON ->> '$.k')::BIGINT END, NULL FROM events""",
    "confidence_line": f"""WITH {SIGNALS}, c AS (SELECT *, coalesce(weight, 0.4::DOUBLE) AS voice, CASE WHEN score IS NULL THEN 0.5 ELSE least(1.0::DOUBLE, score / 0.5::DOUBLE) END::DOUBLE AS ground, 1.0::DOUBLE - greatest(0, iterations - 1)::DOUBLE / 4 AS effort FROM g
), b AS (SELECT *, 0.45::DOUBLE * law + 0.22::DOUBLE * voice + 0.18::DOUBLE * ground + 0.15::DOUBLE * effort AS x, least(law, voice, ground, effort) AS low FROM c
), s AS (SELECT *, CASE WHEN smells THEN least(1.0::DOUBLE, x + 0.03::DOUBLE) ELSE greatest(0.0::DOUBLE, x - 0.08::DOUBLE) END AS y, CASE low WHEN law THEN 'law' WHEN voice THEN 'voice_fit' WHEN ground THEN 'grounding' ELSE 'effort' END AS weakest FROM b
), t AS (SELECT *, printf('%.0f%%', y * 100) AS pc FROM s)
SELECT event_id, CASE WHEN y < 0.45::DOUBLE THEN 'abstaining (' || pc || '); weakest: ' || weakest WHEN y >= 0.78::DOUBLE AND NOT fail THEN 'very likely (' || pc || ')' ELSE 'possible, not certain (' || pc || '); weakest: ' || weakest END AS line FROM t""",
    # The engine's draft names the cue and loses one of its two marks a repair: em_dash weighs 3, list 2 of 7.5.
    "run_loop_full": """WITH c AS (SELECT * FROM (VALUES (1, 'Boats', 'Ship log', 'Draft about harbor boats sail at dawn', 0.9, 'slow', 5, 3, 0.0), (2, 'Bread', 'Oven notes', 'Draft about fresh bread from stone ovens  [list]', 0.4, 'fast', 2, 2, 2.0),
(3, 'Price', 'Shop idea', '[sensitive: removed]', 0.8, 'slow', 4, 3, 0.0)) v(cue_id, gold_used, context_used, final, stakes, path, most, iterations, fail)
), b AS (SELECT *, 0.45::DOUBLE * (1 - fail::DOUBLE / 7.5::DOUBLE) + 0.22::DOUBLE + 0.18::DOUBLE + 0.15::DOUBLE * (1 - (iterations - 1)::DOUBLE / most) AS x FROM c
), s AS (SELECT *, CASE WHEN fail = 0 THEN least(1.0::DOUBLE, x + 0.03::DOUBLE) ELSE x - 0.08::DOUBLE END AS y FROM b)
SELECT cue_id::BIGINT AS cue_id, 'stub' AS model, gold_used, context_used, path, final, (CASE WHEN fail = 0 THEN 0 ELSE 1 END)::INT AS n_fail, fail::DOUBLE AS weighted_fail, iterations::INT AS iterations, fail = 0 AND cue_id <> 3 AS accepted,
round(y, 6) AS score, CASE WHEN fail = 0 AND y >= 0.78::DOUBLE + 0.07::DOUBLE * stakes::DOUBLE THEN 'sure' ELSE 'tentative' END AS verdict, 'effort' AS weakest, cue_id = 3 AS boundary_held FROM s""",
    "index_build": f"{GAP} SELECT n, round(CASE WHEN n < 2 THEN 12 WHEN gap < 1e-4 THEN 20 ELSE least(40, greatest(4, ln(6.0::DOUBLE) / gap)) END::DOUBLE, 6) AS beta FROM q",
    "channel_load": """SELECT channel, subchannel, channel_weight::DOUBLE AS channel_weight, source, title, section, note, date, n::BIGINT AS n FROM (VALUES
('writing', 'Substack', 1.0, 'log', 'morning — Substack (01.02.2026)', 'Days', 'a note', '01.02.2026', length('the harbor wakes before anyone else does')),
('decision', NULL, 1.4, 'decision:alpha', 'cache', 'alpha', 'reversal-cost: ucuz', '2026-01-02', length('durum: reads are slow here.#karar: add one#neden: the ratio is bad#geri alma: ucuz')),
('report', NULL, 0.9, 'report:2026-01-05-audit', 'Audit — Findings', 'Audit', NULL, '2026-01-05', length('nothing broke in the second week, and the logs say why')),
('report', NULL, 0.9, 'report:plain', 'plain', 'plain', NULL, '', length('a report without headings, which is still long enough to be kept')),
('projectdoc', NULL, 0.8, 'projectdoc:beta', 'Beta — State', 'Beta', NULL, '', length('the project map of beta, with more than forty characters')),
('idea', NULL, 1.1, 'idea:parking', 'Ideas — Kiosk', 'Ideas', NULL, '', length('a kiosk for old maps of the coast')),
('desktop', NULL, 1.2, 'desktop:b', 'b', 'b', NULL, '', length('loneliness as a wall, and who builds it'))) v(channel, subchannel, channel_weight, source, title, section, note, date, n)""",
    "load_raw": "SELECT coalesce(source, '') AS channel, '' AS title, 0.0::DOUBLE AS salience, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1",
}
ORACLES["result_records"] = f"""SELECT event_id, '{{"event_id":' || event_id || ',"verdict":"' || verdict || '","score":' || round_even(score, 4)::VARCHAR || ',"weakest":"' || weakest || '"}}' AS record
FROM ({ORACLES["assess_confidence"]}) a"""
# The threshold of each cue by fifty halvings over the list of its scores.
ORACLES["entmax_general"] = f"""WITH RECURSIVE {S}, c AS (SELECT cue_id, list(0.3::DOUBLE * 12 * sim) AS xs, max(0.3::DOUBLE * 12 * sim) AS m FROM s GROUP BY cue_id
), t AS (SELECT cue_id, xs, m - 1 AS low, m AS high, 0 AS step FROM c
UNION ALL SELECT cue_id, xs, CASE WHEN mass >= 1 THEN mid ELSE low END, CASE WHEN mass >= 1 THEN high ELSE mid END, step + 1
FROM (SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(xs, lambda x: power(greatest(x - (low + high) / 2, 0), 1 / 0.3::DOUBLE))) AS mass FROM t WHERE step < 50) h
), u AS (SELECT cue_id, (low + high) / 2 AS tau FROM t WHERE step = 50
), p AS (SELECT s.cue_id, s.id, power(greatest(0.3::DOUBLE * 12 * sim - tau, 0), 1 / 0.3::DOUBLE) AS w FROM s JOIN u ON s.cue_id = u.cue_id)
SELECT cue_id, id, round(w / sum(w) OVER (PARTITION BY cue_id), 6) AS w FROM p"""
ORACLES["supcon_loss"] = f"""WITH {E}, n AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE len(v) > 0
), p AS (SELECT a.id, a.label = b.label AS same, list_dot_product(a.v, b.v) / 0.1::DOUBLE AS s FROM n a JOIN n b ON a.id <> b.id
), r AS (SELECT id, ln(sum(exp(s - 10))) + 10 AS below, avg(CASE WHEN same THEN s END) AS near FROM p GROUP BY id)
SELECT round(avg(below - near), 6) AS loss FROM r WHERE near IS NOT NULL"""
ORACLES["identity_project"] = "SELECT vec_id AS id, 1.0::DOUBLE AS norm FROM embeddings"
ORACLES["encode_cache"] = "SELECT count(*) AS n_rows, count(*) AS n_again, count(DISTINCT coalesce(text, '')) AS n_keys, 0::BIGINT AS n_missed FROM documents"
