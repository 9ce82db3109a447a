"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quarry.llm import quality_rules as qr

_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
members AS (SELECT doc_id, unnest(s) AS m FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM members x JOIN members y ON x.m = y.m AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT b, root FROM reach JOIN both_ways ON a = doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM sizes JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

#: All pairs. The query finds its candidates by tables of keys, which on few rows are one list: there the two are equal.
VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= 0.95 ELSE false END),
reach(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, root FROM reach JOIN links ON a = vec_id),
roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN degree USING (vec_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', hex[i])]), '') AS b FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits
"""


def rules_sql() -> str:
    """Counts by lists of words and windows; cutoffs by binomial tails in logarithms of the gamma function."""
    share = qr.RISK / len(qr.RULES)
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0::DOUBLE END AS r_{r}" for r, (a, b) in qr.RULES.items())
    grid = ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(qr.GRID))
    long = " UNION ALL ".join(f"SELECT lang, good, '{r}' AS rule, r_{r} AS ratio FROM held" for r in qr.RULES)
    rejected = " OR ".join(f"coalesce(r_{r} > (SELECT max(cutoff) FROM best c WHERE c.rule = '{r}' AND c.lang IS NOT DISTINCT FROM f.lang), false)" for r in qr.RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT row_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS g FROM w WHERE len(ws) >= 3),
again AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM win) x WHERE c > 1),
covered AS (SELECT row_id, count(DISTINCT i + k)::BIGINT AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY row_id),
f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_runs
      FROM w LEFT JOIN covered USING (row_id)),
fr AS (SELECT *, {ratios} FROM f),
marked AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT fr.*, good FROM fr JOIN marked USING (doc_id)),
cells AS ({long}),
grid(i, cutoff) AS (VALUES {grid}),
tests AS (SELECT lang, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS bad,
            count(*) FILTER (WHERE good AND ratio > cutoff) AS k, count(*) FILTER (WHERE NOT good AND ratio > cutoff) AS caught
          FROM cells CROSS JOIN grid GROUP BY lang, rule, cutoff),
many AS (SELECT count(*) * {len(qr.RULES) * len(qr.GRID)} AS tests FROM (SELECT DISTINCT lang FROM held) x),
tails AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}::DOUBLE) + (n - i) * ln(1 - {share!r}::DOUBLE)))) AS tail FROM tests WHERE n > 0),
passed AS (SELECT *, CASE WHEN bad > 0 THEN caught::DOUBLE / bad ELSE 0.0::DOUBLE END - {qr.LOSS_WEIGHT!r}::DOUBLE * k / n AS gain FROM tails CROSS JOIN many WHERE tail <= {qr.DELTA!r}::DOUBLE / tests),
best AS (SELECT lang, rule, cutoff FROM passed QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words) AND NOT ({rejected}) AS kept
FROM fr f
"""


def secrets_sql() -> str:
    """Spans from the pieces between matches and the matches; ownership by distinct sources."""
    from quarry.llm import secrets as sec

    def pattern(p: str) -> str:  # the other engine folds letters beyond ASCII too, so cases are written out
        p = p.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
        return p.replace("'", "''")

    parts = []
    for o, (kind, p, group, least) in enumerate((*sec.BASE, *sec.WIDER)):
        parts.append(f"""SELECT row_id, source, {o} AS o, '{kind}' AS kind, s AS start, s + length(m) AS stop, v FROM (
  SELECT row_id, source, unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0)))::BIGINT AS s, unnest(ms) AS m, unnest(vs) AS v
  FROM (SELECT row_id, source, string_split_regex(text, '{pattern(p)}') AS ps, regexp_extract_all(text, '{pattern(p)}', 0) AS ms, regexp_extract_all(text, '{pattern(p)}', {group}) AS vs FROM t) a WHERE len(ms) > 0) b WHERE length(v) >= {least}""")
    base = len(sec.BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
owned AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners FROM spans GROUP BY v),
judged AS (SELECT s.*, owners >= {sec.COPIED_OWNERS} AS wide, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AS live FROM spans s JOIN owned USING (v)),
g AS (SELECT row_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  count(*) FILTER (WHERE wide) AS n_copied, count(*) FILTER (WHERE NOT wide) AS n_owned, count(*) FILTER (WHERE NOT wide AND live) AS n_live,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (WHERE o < {base}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (WHERE o < {base} OR (NOT wide AND live)) AS spans FROM judged GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live FROM t LEFT JOIN g USING (row_id)
"""
