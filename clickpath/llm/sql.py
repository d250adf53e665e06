"""DuckDB SQL of the queries that SQL can express, over the given tables."""

from __future__ import annotations

from clickpath.llm import line_dedup

_SPACE = r"[\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') if x <> ''] AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT DISTINCT doc_id, doc_id FROM documents UNION
  SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON reach.doc_id = both_ways.a),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

LINE_DEDUP = rf"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<title\b.*?</title>', '', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|body|html|head)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t
  FROM pages),
l AS (
  SELECT k, page_id, host, [y for y in [trim(regexp_replace(x, '[\t\r\x0B\f]', ' ', 'g'))
    for x in string_split(coalesce(t, ''), chr(10))] if y <> ''] AS lines FROM p),
u AS (SELECT k, host, unnest(list_distinct(lines)) AS line FROM l),
pages_of AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
common AS (
  SELECT u.host, u.line FROM u JOIN pages_of h ON u.host IS NOT DISTINCT FROM h.host GROUP BY u.host, u.line, h.pages
  HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > {line_dedup.RATIO} * h.pages),
drops AS (
  SELECT u.k, list(u.line) AS drops FROM u JOIN common c ON u.host IS NOT DISTINCT FROM c.host AND u.line = c.line GROUP BY u.k),
s AS (
  SELECT page_id, host, lines, [x for x in lines if NOT list_contains(coalesce(drops, []), x)] AS stay
  FROM l LEFT JOIN drops USING (k))
SELECT page_id, host, array_to_string(stay, chr(10)) AS text, len(lines) AS n_lines, len(lines) - len(stay) AS n_dropped FROM s
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

ORACLE_SQL = {
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op6_topk_search": TOP_K,
    "op8_line_dedup": LINE_DEDUP,
    "op11_warc": WARC,
    "op13_hard_negatives": HARD_NEGATIVES,
}
