"""SQL counterparts for DuckDB, where SQL can express an operator."""

OP5 = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
FROM t WINDOW w AS (PARTITION BY folded)
"""

# Records, digests, offsets and leaves of the archive, then the faults that the replica's rule makes.
OP7 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(page_id::VARCHAR), 1, 2) AS h
  FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT page_id, html, h, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) ||
         'WARC-Record-ID: <urn:page:' AS a, '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) ||
         'Content-Length: ' AS b, chr(13) || chr(10) || chr(13) || chr(10) AS e FROM p),
s AS (
  SELECT page_id, h, (page_id // 4096)::BIGINT AS file, a || page_id || b || strlen(html) || e || html || e AS raw,
         a || page_id || b || strlen(substr(html, 2) || '~') || e || substr(html, 2) || '~' || e AS bad,
         a || (-page_id - 1) || b || strlen(html) || e || html || e AS twin FROM r),
o AS (
  SELECT *, (sum(strlen(raw)) OVER (PARTITION BY file ORDER BY page_id, sha256(raw)) - strlen(raw))::BIGINT // 65536 AS leaf FROM s)
SELECT file, leaf, page_id, CASE WHEN h IN ('10', '11') THEN 'missing' ELSE 'corrupt' END AS status, sha256(raw) AS expected,
       CASE WHEN h IN ('00', '01') THEN sha256(bad) END AS found
FROM o WHERE h IN ('00', '01', '10', '11') AND (h IN ('10', '11') OR raw <> bad)
UNION ALL
SELECT floor((-page_id - 1) / 4096)::BIGINT, 0::BIGINT, -page_id - 1, 'extra', NULL, sha256(twin) FROM o WHERE h = '20'
"""

OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS units
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.units, b.units)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
