"""Toxicity, word runs and lexical search against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical_search as lexical
from weftline.llm import periodic_runs as runs
from weftline.llm import toxicity
from weftline.llm.queries import QUERIES
from weftline.sources import read_table

from .conftest import SCHEMA, make_text, odd_rows

# word runs


def plain_runs(words, least=12):
    """All runs by comparing every word with the one q places on, for every q."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q) and i > start:
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text, planted=True):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(found), *best, exponent, *sha)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def arrays(docs):
    x, starts, ends = [-1, -2, -3], [], []
    for k, d in enumerate(docs):
        starts.append(len(x))
        x += d
        ends.append(len(x))
        x.append(-4 - k)
    x += [-4 - len(docs) - k for k in range(3)]
    return np.array(x, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def test_runs_of_random_and_periodic_words():
    rng = random.Random(5)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 140), rng.choice([1, 2, 2, 3, 6])
            d = [rng.randrange(k) for _ in range(n)]
            p, a = rng.randint(1, 40), rng.randrange(n) if n else 0
            docs.append([d[a + (i - a) % p] if i >= a and a + p < n else d[i] for i in range(n)])
        x, starts, ends = arrays(docs)
        got = runs.find_runs(x, starts, ends).tolist()
        want = [(s + b, s + n + b, q) for d, b in zip(docs, starts.tolist(), strict=True) for s, n, q in plain_runs(d)]
        assert [tuple(r) for r in got] == want


def test_runs_of_fibonacci_words_and_z_function():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    got = runs.find_runs(*arrays([b])).tolist()
    assert sorted((s - 3, e - s, q) for s, e, q in got) == plain_runs(b)
    z = runs.z_function(b)
    assert all(b[i : i + z[i]] == b[: z[i]] and (i + z[i] == len(b) or b[z[i]] != b[i + z[i]]) for i in range(1, len(b)))


def test_runs_of_long_repetitive_texts_take_little_time():
    began = time.perf_counter()
    got = runs.find_runs(*arrays([[0] * 60_000, [i % 7 for i in range(60_000)], list(range(60_000))]))
    assert [(e - s, q) for s, e, q in got.tolist()] == [(60_000, 1), (60_000, 7)]
    assert time.perf_counter() - began < 30


def test_runs_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op12_word_runs"](spark, sf).select(*COLUMNS).collect())
    assert got == sorted(plain_row(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect())
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_rows(spark, odd, empty):
    docs = odd.withColumn("start", F.lit(1)).withColumn("x", F.lit("clash")).withColumn("Text ", F.lit(0))
    got = Counter(tuple(r) for r in runs.detect_runs(docs, planted=runs.plant).select(*COLUMNS).collect())
    assert got == Counter(plain_row(r[0], r[1]) for r in odd_rows())
    whole = runs.detect_runs(spark.createDataFrame([(1, "a b " * 9 + "c", "", "", 0)], SCHEMA)).collect()[0]
    assert bytes(whole["collapsed"]) == b"a b c" and [tuple(r) for r in whole["runs"]] == [(0, 18, 2)]
    assert runs.detect_runs(empty).count() == 0


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    held = [(d, Counter(t)) for d, t in ((d, plain_terms(t)) for d, t in docs) if t]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(plain_terms(t))
    out = []
    for i, terms in wanted.items():
        found = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def ranking(docs, items, **named):
    return sorted((tuple(r) for r in lexical.lexical_search(docs, items, **named).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "tiny TEXT one ananan"), (2, ""), (3, None), (None, "one"), (1, "er, er; ti"), (4, "zzz"), (5, "one"), (5, "one"), (6, "é th on re ti an er")]


def test_search_equals_brute_force_on_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    docs = odd.withColumn("item_id", F.lit(9)).withColumn("n", F.lit(None).cast("long"))
    want = plain_ranking([r[:2] for r in odd_rows()], ITEMS, 7)
    assert ranking(docs, items, k=7) == want and len(want) > 10
    assert ranking(docs, items, k=7, block_terms=1) == want  # a pass for each item
    assert ranking(empty, items) == [] and ranking(docs, items.limit(0)) == []


def test_search_over_many_shards_with_ties(spark):
    rng = random.Random(3)
    docs = [(rng.randrange(400), make_text(rng, rng.choice([0, 1, 5, 30])), "en", "s", 0) for _ in range(600)]
    items = [(i, make_text(rng, 12)) for i in range(12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = ranking(spark.createDataFrame(docs, SCHEMA).repartition(6), spark.createDataFrame(items, "item_id long, text string"), k=20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_ranking([d[:2] for d in docs], items, 20)


@pytest.mark.parametrize("window", [1, 3, 64])
def test_wand_gives_the_best_and_skips(window):
    rng = np.random.default_rng(1)
    n = 5000
    lists, total = [], np.zeros(n, np.int64)
    for share, top in ((0.9, 3), (0.5, 10), (0.02, 300), (0.01, 900)):
        docs = np.flatnonzero(rng.random(n) < share)
        impacts = rng.integers(1, top + 1, len(docs))
        total[docs] += impacts
        lists.append((docs, impacts, int(impacts.max())))
    heap = lexical.Heap(10)
    scored = lexical.wand(lists, heap, np.arange(n), np.zeros(n, bool), window)
    order = np.lexsort((np.arange(n), -total))[:10]
    assert heap.ids.tolist() == order.tolist() and heap.scores.tolist() == total[order].tolist()
    assert scored < n / 2


# toxicity


def test_isotonic_fit_is_nondecreasing_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    m = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, share = toxicity.isotonic(m, y)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and 0 <= share[0] <= share[-1] <= 1
    # against the minimum over all later and maximum over all earlier starts of mean labels
    s = y[np.argsort(m, kind="stable")]
    sums = np.concatenate([[0], np.cumsum(s)])
    want = [max(min((sums[j] - sums[i]) / (j - i) for j in range(k + 1, 301)) for i in range(k + 1)) for k in range(300)]
    assert np.allclose(sorted(set(np.round(want, 12))), np.round(share, 12))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.grow(x, y)
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.97
    assert (trees.margin(np.zeros((0, 3))) == np.zeros(0)).all()


def test_masked_words_count_as_what_they_stand_for():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {"stup": 4.0})
    f = dict(zip(toxicity.NAMES, toxicity.text_features("YOU 1d1ot, you id!ot; STUPIDO i.d.i.o.t", lexicon, {}), strict=True))
    alone = dict(zip(toxicity.NAMES, toxicity.text_features("you are an id!ot", lexicon, {}), strict=True))
    assert alone["hits"] == alone["masked_hits"] == 1 and alone["near_hits"] == 0  # has no place among the words
    assert f["masked"] == f["masked_hits"] == 3 and toxicity.undone("1d1ot") == "idiot"
    assert f["hits"] == 4 and f["strong_hits"] == 3 and f["whole_hits"] == 0 and f["nearest"] <= 5 and f["second_person"] > 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op11_boosted_toxicity"](spark, sf)
    rows = scored.join(read_table(spark, sf, "labels"), "doc_id").collect()
    assert scored.count() == 1000 and {r["held_out"] for r in rows} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["toxic"] == t] for t in (0, 1))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9 and np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_never_train(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    labels = read_table(spark, "/root/testdata/sf0.001", "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(tuple(r) for r in toxicity.score_toxicity(docs, toxicity.train(docs, x)).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100, 3)] + [(None, 1), (3, 0), (6, None)], "doc_id long, toxic int")
    docs = odd.withColumn("toxic", F.lit("clash")).withColumn("fold", F.lit(1)).withColumn("score", F.lit(0.0))
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0
    none = toxicity.train(docs, labels.where("toxic = 7"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
