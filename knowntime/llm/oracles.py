"""Checking SQL (DuckDB) of the operators whose contract SQL can express over whole tables."""

from __future__ import annotations

SUFFIX_DEDUP = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
p AS (SELECT doc_id, hx, unnest(range(0, CAST(len(hx) // 2 - 49 AS BIGINT))) AS i FROM h WHERE len(hx) >= 100),
w AS (SELECT doc_id, i, substr(hx, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM p),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.d < w.doc_id),
l AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
c AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
t AS (SELECT h.doc_id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(hx, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head,
      substr(any_value(hx), CAST(2 * max(b) + 1 AS BIGINT)) AS tail FROM c JOIN h USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, CAST(len(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN hx ELSE head || tail END)) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id)"""

NGRAM_JOIN = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT b.y AS doc_id, r.c FROM r JOIN both_ways b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.sh)"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 10"""
