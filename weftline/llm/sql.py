"""SQL twins for DuckDB of the queries that SQL can express."""

from __future__ import annotations

#: Classes of near copies by comparing all texts that share a shingle.
NEAR_CLASSES = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
keyed AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE chr(1) || t END AS key FROM docs),
texts AS (SELECT key, row_number() OVER (ORDER BY key) AS x, min(doc_id) AS least, any_value(w) AS w FROM keyed GROUP BY key),
shingles AS (SELECT x, s, count(*)::DOUBLE AS n FROM (SELECT x, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
  lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM texts WHERE len(w) > 0) GROUP BY ALL),
sizes AS (SELECT x, count(*) AS c, sum(n) AS total, max(n) AS most FROM shingles GROUP BY x),
pairs AS (SELECT a.x AS ax, b.x AS bx, count(*) AS shared, sum(least(a.n / p.total, b.n / q.total)) AS overlap
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.x < b.x JOIN sizes p ON p.x = a.x JOIN sizes q ON q.x = b.x GROUP BY 1, 2),
judged AS (SELECT ax, bx, shared / (p.c + q.c - shared) AS plain, overlap, greatest(p.most, q.most) AS most
  FROM pairs JOIN sizes p ON p.x = ax JOIN sizes q ON q.x = bx),
-- the probability Jaccard similarity is never above the overlap of the two distributions
candidates AS (SELECT ax, bx FROM judged WHERE plain < 0.8 AND most > 1 AND overlap >= 0.8 - 1e-9),
unions AS (SELECT ax, bx, s, sum(a) AS a, sum(b) AS b FROM (
  SELECT ax, bx, s, n AS a, 0 AS b FROM candidates JOIN shingles ON x = ax UNION ALL SELECT ax, bx, s, 0, n FROM candidates JOIN shingles ON x = bx) GROUP BY 1, 2, 3),
weighted AS (SELECT ax, bx, sum(1 / bound) AS p FROM (SELECT u.ax, u.bx, u.s, sum(greatest(y.a / u.a, y.b / u.b)) AS bound
  FROM unions u JOIN unions y ON y.ax = u.ax AND y.bx = u.bx WHERE u.a > 0 AND u.b > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
links AS (SELECT ax, bx FROM judged WHERE plain >= 0.8 - 1e-12 UNION SELECT ax, bx FROM weighted WHERE p >= 0.8 - 1e-12
  UNION SELECT a.x, b.x FROM keyed j JOIN keyed k ON j.doc_id = k.doc_id JOIN texts a ON a.key = j.key JOIN texts b ON b.key = k.key WHERE a.x < b.x),
edges AS (SELECT ax AS a, bx AS b FROM links UNION SELECT bx, ax FROM links),
reach(a, b) AS (SELECT x, x FROM texts UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
labels AS (SELECT reach.a AS x, min(t.least) AS class_id FROM reach JOIN texts t ON t.x = reach.b GROUP BY 1)
SELECT k.doc_id, l.class_id FROM keyed k JOIN texts t ON t.key = k.key JOIN labels l ON l.x = t.x
"""

#: Bytes as hex digits: two for each byte, so 50 bytes are 100.
REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(hex(encode(text)), '') AS hx FROM documents),
parts AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS ord, c, substr(hx, 2 * c + 1, 2 * 305) AS part
  FROM (SELECT *, unnest(range(0, length(hx) // 2 - 49, 256)) AS c FROM docs WHERE length(hx) >= 100)),
strings AS (SELECT rid, ord, c + k AS i, substr(part, 2 * k + 1, 100) AS g
  FROM (SELECT *, unnest(range(0, length(part) // 2 - 49)) AS k FROM parts)),
firsts AS (SELECT g, min(ord) AS m FROM strings GROUP BY g),
hits AS (SELECT rid, i FROM strings JOIN firsts USING (g) WHERE ord > m),
runs AS (SELECT rid, i, lead(i) OVER w AS nx, lag(i) OVER w AS pv FROM hits WINDOW w AS (PARTITION BY rid ORDER BY i)),
kept AS (SELECT r.rid, sum(least(50, coalesce(nx - i, 50)))::BIGINT AS n_removed,
  (count(*) FILTER (pv IS NULL OR i - pv > 50))::BIGINT AS n_spans, max(i) + 50 AS last_end,
  string_agg(CASE WHEN pv IS NULL THEN substr(hx, 1, 2 * i) WHEN i - pv > 50 THEN substr(hx, 2 * (pv + 50) + 1, 2 * (i - pv - 50)) END, '' ORDER BY i) AS head
  FROM runs r JOIN docs d ON d.rid = r.rid GROUP BY r.rid)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN k.rid IS NULL THEN unhex(hx) ELSE unhex(coalesce(head, '') || substr(hx, 2 * last_end + 1)) END) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.rid = d.rid
"""

#: A term's weight and a document's share of it are the query's own integers, so scores are equal to the last digit.
RANKED = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT rid, doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0),
figures AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS total FROM held),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
counts AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM held)
    WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS wt
    FROM (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY 1), figures),
scores AS (SELECT q.item_id, c.rid, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // total))))::BIGINT AS score
    FROM wanted q JOIN weights USING (term) JOIN counts c USING (term) JOIN held h ON h.rid = c.rid, figures GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT s.item_id, h.doc_id, score,
    (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST))::INTEGER AS rank
    FROM scores s JOIN held h ON h.rid = s.rid WHERE score > 0) WHERE rank <= 50
"""


def twins(shard_bytes: int) -> dict[str, str]:
    """By query; shard_bytes: the limit of a shard."""
    shards = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), tree(d, p, bytes) AS (
  SELECT 0, 0::BIGINT, coalesce(sum(n_bytes), 0)::BIGINT FROM rows
  UNION ALL
  SELECT t.d + 1, r.h >> (60 - (t.d + 1)), sum(r.n_bytes)::BIGINT
  FROM tree t JOIN rows r ON r.h >> (60 - t.d) = t.p
  WHERE t.bytes > {shard_bytes} AND t.d < 24 GROUP BY 1, 2
)
SELECT r.doc_id, r.n_bytes, t.d::INTEGER AS depth, t.d || '-' || t.p AS shard
FROM rows r JOIN tree t ON t.bytes <= {shard_bytes} AND r.h >> (60 - t.d) = t.p
"""
    return {"op3_probminhash": NEAR_CLASSES, "op4_suffix_groups": REPEATS, "op5_extendible_sharding": shards, "op13_wand_search": RANKED}
