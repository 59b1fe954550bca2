"""DuckDB SQL for the corpus queries that SQL can express, written from what they return and not from how they find it.

Without SQL: op3 and op4 (models), op7 (which documents a hash threshold takes), op9 (sketches), op10 (parsing of nested quotes),
pipeline (a model and a threshold among its stages). Their tests hold them against brute force or held-out rows.
"""

from __future__ import annotations

from .secret_scan import RULES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR = (
    """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce("""
    + _LOWER.format("text")
    + """, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
   ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) END AS sh FROM w),
 u AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
 e AS (SELECT a.doc_id AS p, b.doc_id AS q FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 r(p, q) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.p, e.q FROM r JOIN e ON r.q = e.p),
 c AS (SELECT p, min(q) AS component_id FROM r GROUP BY p)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.p"""
)

_WORDS = "regexp_extract_all(coalesce(" + _LOWER.format("text") + ", ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
 i AS (SELECT DISTINCT item, array_to_string(ws[k:k + least(13, len(ws)) - 1], ' ') AS win, least(13, len(ws)) AS n
   FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
 n AS (SELECT DISTINCT n FROM i), p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, n WHERE len(ws) >= n),
 h AS (SELECT doc_id, k, p.n, item FROM (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM p) p JOIN i ON p.win = i.win AND p.n = i.n),
 hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

#: Prefixes by exact document frequencies, then whole sets; earlier lines by (doc_id, line).
_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, line, list_distinct(list_filter(string_split_regex(lower(body), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')) AS ws FROM l),
 t AS (SELECT doc_id, line, ws, row_number() OVER (ORDER BY doc_id, line) AS no FROM s WHERE len(ws) > 0),
 k AS (SELECT list_sort(ws) AS key, any_value(ws) AS ws, min(no) AS no FROM t GROUP BY 1),
 u AS (SELECT no, len(ws) AS n, unnest(ws) AS w FROM k), f AS (SELECT w, count(*) AS f FROM u GROUP BY w),
 o AS (SELECT no, n, w FROM u JOIN f USING (w) QUALIFY row_number() OVER (PARTITION BY no ORDER BY f, w) <= n // 5 + 1),
 c AS (SELECT DISTINCT a.no AS later, b.no AS earlier FROM o a JOIN o b ON a.w = b.w AND a.no > b.no AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
 v AS (SELECT DISTINCT later FROM c JOIN k a ON a.no = later JOIN k b ON b.no = earlier WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (len(a.ws) + len(b.ws))),
 g AS (SELECT t.doc_id, list(t.line) AS lines FROM t JOIN k ON list_sort(t.ws) = k.key WHERE t.no <> k.no OR k.no IN (SELECT later FROM v) GROUP BY t.doc_id)
SELECT doc_id, CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(lines, i - 1)), chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_removed
FROM documents LEFT JOIN g USING (doc_id)"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS start,
  length(whole[k]) AS n FROM (SELECT doc_id, gaps, whole, counted, unnest(range(1, len(whole) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '{quoted}') AS gaps,
  regexp_extract_all(text, '{quoted}') AS whole, regexp_extract_all(text, '{quoted}', {group}) AS counted FROM d)) WHERE length(counted[k]) >= {least}"""


_NAMED = "concat(kind, ':', start, ':', start + n)"
_SECRETS = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, n FROM ("
    + " UNION ALL ".join(_spans(k, *rule) for k, rule in enumerate(RULES))
    + f""")), a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg({_NAMED}, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg({_NAMED}, ',' ORDER BY start, rank, n) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
)

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
_ARCHIVE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), q AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM q"""

ORACLES: dict[str, str] = {"op1_near_dedup": _NEAR, "op2_decontamination": _LEAKS, "op5_line_dedup": _LINES, "op6_secret_scan": _SECRETS, "op8_warc": _ARCHIVE}
