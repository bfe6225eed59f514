"""DuckDB statements of the queries that SQL can express."""

# Documents and items as token lists; candidate alignments share four tokens in
# a row (any 13 places with at most 2 differences do), then places are compared.
OP8_LEAKS = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), dt AS (SELECT doc_id, generate_subscripts(w, 1) AS p, w FROM d WHERE len(w) >= 4
), dg AS (SELECT doc_id, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] AS g FROM dt WHERE p + 3 <= len(w)
), bt AS (SELECT item_id, generate_subscripts(w, 1) AS p, w FROM b WHERE len(w) >= 4
), bg AS (SELECT item_id, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] AS g FROM bt WHERE p + 3 <= len(w)
), c AS (SELECT DISTINCT doc_id, item_id, dg.p - bg.p AS shift FROM dg JOIN bg USING (g)
), e AS (
  SELECT c.doc_id, c.item_id, c.shift, len(b.w) AS n,
         list_transform(range(1, len(b.w) + 1),
           lambda q: CASE WHEN q + shift >= 1 AND q + shift <= len(d.w) AND d.w[q + shift] = b.w[q] THEN 1 ELSE 0 END) AS eq
  FROM c JOIN d USING (doc_id) JOIN b USING (item_id)
), f AS (
  SELECT doc_id, item_id, shift, n, list_sum(eq) AS n_equal,
         list_max(list_transform(range(1, n - least(n, 13) + 2), lambda s: list_sum(eq[s : s + least(n, 13) - 1]))) AS best
  FROM e
)
SELECT doc_id, item_id, arg_max(shift, n_equal * 1000000000 - shift)::INT AS doc_start,
       max(n_equal)::INT AS n_equal, any_value(n)::INT AS n_item
FROM f WHERE best >= CASE WHEN n < 13 THEN n ELSE 11 END
GROUP BY doc_id, item_id
"""

# Distinct sets, all pairs that share a shingle, then the transitive closure.
OP9_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS sh
  FROM d
), k AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, '|')) AS h, sh FROM s
), c AS (SELECT h, min(doc_id) AS cid, any_value(n) AS n, any_value(sh) AS sh FROM k WHERE n > 0 GROUP BY h
), e AS (SELECT cid, n, unnest(sh) AS g FROM c
), p AS (
  SELECT a.cid AS x, b.cid AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
  FROM e a JOIN e b ON a.g = b.g AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.cid, b.cid
), l AS (SELECT x, y FROM p WHERE 100 * o >= 90 * (nx + ny - o)
), both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (SELECT cid AS x, cid AS y FROM c UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x
), m AS (SELECT x AS cid, min(y) AS component_id FROM r GROUP BY x)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id
FROM k LEFT JOIN c ON c.h = k.h AND k.n > 0 LEFT JOIN m ON m.cid = c.cid
"""

# Term counts of all documents, then every document that shares a term.
OP11_RMQ = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), dn AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0
), st AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nw FROM dn
), i AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS t FROM i) GROUP BY ALL
), f AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), w AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, st GROUP BY t
), s AS (
  SELECT q.i, q.item_id, f.r, sum(q.c * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * dn.n * st.nd) // st.nw))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN w USING (t) JOIN dn USING (r), st GROUP BY ALL
), k AS (
  SELECT i, item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM s JOIN dn USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

# Every anchor against all rows, in integers (products of doubles that stay
# whole), then windows of scores round each positive.
OP13_GNAT = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
