"""Benchmark overlap, addresses and page texts against plain versions."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from weftline.functions import html as pages_html
from weftline.operators.overlap import overlap
from weftline.operators.pages import canonical_pages, page_texts
from weftline.sources import read_table

SF = "/root/testdata/sf0.1"


# overlap


def plain_overlap(docs, items, n, stock):
    def words(t):
        return tuple(re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))

    docs, items = {(d, words(t)) for d, t in docs}, {(i, words(t)) for i, t in items if i is not None}
    holders = defaultdict(set)
    for i, w in items:
        for k in range(len(w) - n + 1):
            holders[w[k : k + n]].add(i)
    out = []
    for d, dw in docs:
        places = defaultdict(list)
        for k in range(len(dw) - n + 1):
            places[dw[k : k + n]].append(k)
        for i, w in items:
            hits = {(p, k) for k in range(len(w) - n + 1) for p in places.get(w[k : k + n], ())}
            if not any(len(holders[w[k : k + n]]) <= stock for _, k in hits):
                continue
            covered = {k + j for _, k in hits for j in range(n)}
            longest = 0
            for p, k in hits:
                if (p - 1, k - 1) not in hits:
                    length = 0
                    while (p + length, k + length) in hits:
                        length += 1
                    longest = max(longest, length + n - 1)
            out.append((d, i, len(w), len(covered), longest))
    return sorted(out, key=str)


@pytest.mark.parametrize("places", [10**6, 0])
def test_overlap_equals_comparing_all(spark, places):
    rng = random.Random(1)
    some = lambda k: " ".join(rng.choice("ab c De é 1 f g".split()) for _ in range(k))
    phrase = some(9)
    items = [(i, f"{some(rng.randint(0, 12))} {phrase if i % 2 else ''} {some(3)}") for i in range(14)] + [(None, phrase), (3, some(8)), (5, None)]
    docs = [(i, f"{some(rng.randint(0, 40))} {phrase if i % 3 else ''}, {rng.choice(items)[1]}") for i in range(60)]
    docs += [(None, docs[4][1]), (7, docs[7][1]), (8, None), (9, ""), (9, docs[4][1]), (61, "a b " * 300)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("gram", F.lit("x")).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("at", F.lit(0))
    for n, stock in ((4, 3), (3, 100)):
        got = sorted((tuple(r) for r in overlap(d, i, n, stock, broadcast_places=places).collect()), key=str)
        assert got == plain_overlap(docs, items, n, stock) and len(got) > 20
    assert overlap(d.limit(0), i).count() == 0 and overlap(d, i.limit(0)).count() == 0


# addresses


def test_addresses_in_one_form(spark):
    same = {
        "http://a.org/x": ["HTTP://A.org:80//x/#top", "http://u:p@a.org./x?utm_source=1&ref=2", "http://a.org/x?", " http://a.org/x?&"],
        "https://a.org:8443/?a=1&b=2": ["https://a.org:8443?b=2&a=1&gclid=7", "https://A.ORG:8443/?b=2&&a=1#x"],
        "mailto:x@y": ["mailto:x@y"],
        "": [""],
    }
    rows = [(k, u) for k, u in enumerate([u for us in same.values() for u in us] + [None, None])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("address", F.lit(1)).withColumn("c", F.lit(2))
    got = {r["page_id"]: r for r in canonical_pages(df).collect()}
    k = 0
    for want, urls in same.items():
        for _ in urls:
            r = got[k]
            assert (r["canonical"], r["n_same"], r["first_page_id"] <= k) == (want, len(urls), True), r
            k += 1
    assert all(got[k + j]["n_same"] == 0 and got[k + j]["first_page_id"] is None for j in (0, 1))
    assert canonical_pages(df.limit(0)).count() == 0


# pages


class Plain(HTMLParser):
    """The rules of read_page on the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.link, self.n_links, self.title, self.inside = [], [], False, 0, None, None
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            self.blocks.append((text, sum(len("".join(p.split())) for p, linked in self.parts if linked)))
        self.parts = []

    def edge(self, tag):
        if tag in pages_html.BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append((" ", False))

    def handle_starttag(self, tag, attrs):
        self.edge(tag)
        if tag == "a":
            self.link, self.n_links = True, self.n_links + 1
        if tag in pages_html.RAW:
            self.inside = tag

    def handle_endtag(self, tag):
        self.edge(tag)
        if tag == "a":
            self.link = False
        self.inside = None

    def handle_data(self, data):
        if self.inside == "title" and self.title is None:
            self.title = " ".join(data.split())
        if self.inside not in pages_html.HIDDEN:
            self.parts.append((data, self.link))


def plain_page(page):
    p = Plain(page)
    sizes = [len(t.replace(" ", "")) for t, _ in p.blocks]
    kept = [t for (t, linked), n in zip(p.blocks, sizes, strict=True) if linked <= n / 2]
    return (p.title, "\n".join(kept), len(p.blocks), len(kept), p.n_links, sum(sizes), sum(x for _, x in p.blocks))


def test_page_texts_equal_a_plain_parser_on_all_pages(spark):
    pages = read_table(spark, SF, "pages")
    got = {r["page_id"]: tuple(r)[1:] for r in page_texts(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == plain_page(r["html"])
    assert len(got) == 2500 and sum(r[2] > r[3] for r in got.values()) > 100


def test_odd_pages(spark):
    cases = {
        None: ("", None), "": ("", None), "plain &amp; text": ("plain & text", None),
        "<p>a<p>b<br>c <!-- <p>x --> d</p>": ("a\nb c d", None),
        "<title> T &lt;\n1 </title><p title='a>b'>c</p>": ("c", "T < 1"),
        "<script>if (a<b) '</p>'</script>x<SCRIPT>y</SCRIPT >z": ("xz", None),
        "a < b <3 </ x>y": ("a < b <3 y", None), "<ul><li><a href=x>menu</a> !</ul>text": ("text", None),
        "<p>a<script>never closed": ("a", None), "<p>a<b class=\"x": ("a", None), "a<": ("a<", None), "<![CDATA[x]]>y<?p q>": ("y", None),
    }
    df = spark.createDataFrame([(k, p) for k, p in enumerate(cases)], "page_id long, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["title"]) for r in page_texts(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert page_texts(df.limit(0)).count() == 0


def test_pages_are_read_in_linear_time():
    began = time.perf_counter()
    for piece in ("<a \"", "<!--", "<script>", "<", "</", "<a <b", "&amp", "<title>", "<p><a>x"):
        pages_html.read_page(piece * 50_000)
    assert time.perf_counter() - began < 20
