"""Work on the text, page and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.fingerprints import GAPS, MARKED, MARKS, PLAIN, fingerprints
from weftline.operators.lines import remove_repeated_lines
from weftline.operators.nearest import exact_nearest
from weftline.operators.overlap import overlap
from weftline.operators.pages import ADDRESS, TRACKING, canonical_pages, page_texts
from weftline.plans.base import Catalog, Tables

QUERIES = Catalog()


@QUERIES.add(
    r"""WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
    b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    dg AS (SELECT doc_id, w, i, w[i + 1:i + 8] AS g FROM (SELECT *, unnest(range(0, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
    bg AS (SELECT item_id, w, i, w[i + 1:i + 8] AS g FROM (SELECT *, unnest(range(0, len(w) - 7)) AS i FROM b WHERE len(w) >= 8)),
    stock AS (SELECT g FROM bg GROUP BY g HAVING count(DISTINCT item_id) > 20),
    hits AS (SELECT dg.doc_id, dg.w AS dw, bg.item_id, bg.w AS bw, dg.i - bg.i AS diagonal, bg.i AS spot, bg.g IN (FROM stock) AS is_stock
        FROM dg JOIN bg ON dg.g = bg.g),
    chained AS (SELECT *, spot - row_number() OVER (PARTITION BY doc_id, dw, item_id, bw, diagonal ORDER BY spot) AS passage FROM hits),
    longest AS (SELECT doc_id, dw, item_id, bw, max(n) + 7 AS longest FROM (SELECT doc_id, dw, item_id, bw, count(*) AS n
        FROM chained GROUP BY doc_id, dw, item_id, bw, diagonal, passage) GROUP BY 1, 2, 3, 4),
    covered AS (SELECT doc_id, dw, item_id, bw, count(DISTINCT spot + k) AS covered, bool_and(is_stock) AS only_stock
        FROM (SELECT *, unnest(range(8)) AS k FROM hits) GROUP BY 1, 2, 3, 4)
    SELECT c.doc_id, c.item_id, len(c.bw)::BIGINT AS item_words, covered::BIGINT AS covered_words, longest::BIGINT AS longest_passage
    FROM covered c JOIN longest l ON c.doc_id IS NOT DISTINCT FROM l.doc_id AND c.dw = l.dw AND c.item_id = l.item_id AND c.bw = l.bw
    WHERE NOT only_stock"""
)
def x_benchmark_overlap(t: Tables) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return overlap(t.documents, t.benchmark)


@QUERIES.add(
    rf"""WITH parts AS (SELECT page_id, url, regexp_matches(url, '{ADDRESS}') AS known, lower(regexp_extract(url, '{ADDRESS}', 1)) AS scheme,
        regexp_extract(url, '{ADDRESS}', 2) AS place, regexp_extract(url, '{ADDRESS}', 3) AS path, regexp_extract(url, '{ADDRESS}', 4) AS query FROM pages),
    pieces AS (SELECT *, regexp_replace(lower(regexp_replace(place, '^.*@', '')), '\.?(:\d*)?$', '') AS h, regexp_extract(place, ':(\d+)$', 1) AS port,
        regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS p,
        list_sort(list_filter(string_split(query, '&'), lambda x: x != '' AND NOT regexp_matches(lower(x), '{TRACKING}'))) AS wanted FROM parts),
    made AS (SELECT page_id, CASE WHEN known THEN scheme || '://' || h
        || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
        || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(wanted) > 0 THEN '?' || array_to_string(wanted, '&') ELSE '' END ELSE url END AS canonical,
        CASE WHEN known AND h != '' THEN h END AS host FROM pieces)
    SELECT page_id, canonical, host, CASE WHEN canonical IS NOT NULL THEN min(page_id) OVER (PARTITION BY canonical) END AS first_page_id,
        CASE WHEN canonical IS NOT NULL THEN count(*) OVER (PARTITION BY canonical) ELSE 0 END AS n_same FROM made"""
)
def x_url_canonical(t: Tables) -> DataFrame:
    """Addresses in one form, and which pages share one."""
    return canonical_pages(t.pages)


@QUERIES.add(None)
def x_page_text(t: Tables) -> DataFrame:
    """The text of pages without menus; no SQL twin, a plain parser checks it on all pages."""
    return page_texts(t.pages)


@QUERIES.add(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
        FROM v q JOIN v c ON c.vec_id != q.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs)
    WHERE rank <= 20"""
)
def x_exact_knn(t: Tables) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, exactly."""
    return exact_nearest(t.embeddings, F.col("vec_id") % 20 == 0)


@QUERIES.add(
    r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT rid, doc_id, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(13)) AS bare
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
    repeated AS (SELECT bare FROM l WHERE bare != '' GROUP BY bare HAVING count(DISTINCT rid) >= 5),
    marked AS (SELECT *, bare IN (FROM repeated) AS gone FROM l)
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
        md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5 FROM marked GROUP BY rid, doc_id"""
)
def x_repeated_lines(t: Tables) -> DataFrame:
    """Documents without the lines that five or more of them hold."""
    found = remove_repeated_lines(t.documents.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@QUERIES.add(
    rf"""WITH folded AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(lower(translate(translate(text, '{MARKED}', '{PLAIN}'),
        (SELECT string_agg(chr((65281 + k)::INTEGER), '' ORDER BY k) FROM range(94) r(k)), (SELECT string_agg(chr((33 + k)::INTEGER), '' ORDER BY k) FROM range(94) r(k)))),
        '{MARKS}', '', 'g'), '{GAPS}', ' ', 'g'), ' ') AS words FROM documents),
    made AS (SELECT doc_id, md5(text) AS text_md5, md5(CASE WHEN words != '' THEN words ELSE chr(1) || text END) AS words_md5 FROM folded)
    SELECT doc_id, text_md5, CASE WHEN text_md5 IS NOT NULL THEN min(doc_id) OVER (PARTITION BY text_md5) END AS exact_id, words_md5,
        CASE WHEN words_md5 IS NOT NULL THEN min(doc_id) OVER (PARTITION BY words_md5) END AS class_id,
        CASE WHEN words_md5 IS NOT NULL THEN count(*) OVER (PARTITION BY words_md5) ELSE 0 END AS n_same FROM made"""
)
def x_fingerprints(t: Tables) -> DataFrame:
    """Documents with the same text, and with the same words whatever their case, accents and punctuation."""
    return fingerprints(t.documents)
