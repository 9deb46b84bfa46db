from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import near_dedup
from weftline.llm.near_dedup import COMPONENTS, PROMISING, WORDS, keep_one, near_classes, normal, shingles, signatures, similarity_of
from weftline.sources import read_table

from .conftest import SCHEMA, make_text


def brute(rows):
    """Classes by comparing all pairs of texts, as sets of shingles."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    texts = [(r[0], r[1] or "") for r in rows if r[0] is not None]
    made = []
    for i, t in texts:
        w = normal(t).split()
        made.append((i, t, frozenset(tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))) if w else frozenset()))
    for x, (i, t, a) in enumerate(made):
        for j, u, b in made[:x]:
            same = a == b if a and b and not (a ^ b) else (t == u if not a and not b else False)
            if same or (a and b and len(a & b) / len(a | b) >= 0.8):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in near_classes(df).collect()}


def test_odd_rows(spark, odd):
    from .conftest import odd_rows

    assert classes(odd) == brute(odd_rows())


def test_chains_and_large_groups(spark):
    rng = random.Random(3)
    words = make_text(rng, 150).split()
    rows = []
    for k in range(60):  # each a few words from the one before, so far ends differ
        words = list(words)
        words[rng.randrange(150)] = f"new{k}"
        rows.append((k, " ".join(words), "en", "s", 0))
    seed = make_text(rng, 120).split()
    for k in range(60, 160):  # copies of one text, which differ among each other
        own = list(seed)
        own[k % 120] = f"edit{k}"
        rows.append((k, " ".join(own), "en", "s", 0))
    rng.shuffle(rows)
    assert classes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_copies_that_differ_in_repeats(spark):
    """Plain similarity 0.9 and more, probability Jaccard far below."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        base = make_text(rng, 300)
        often = " ".join([base] + [" ".join(base.split()[a : a + 14]) for a in (20,) for _ in range(60)])
        more = " ".join([base] + [" ".join(base.split()[150:162])] * 80)
        rows += [(3 * k, base, "en", "s", 0), (3 * k + 1, often, "en", "s", 0), (3 * k + 2, more, "en", "s", 0)]
    got = classes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == brute(rows) and len(set(got.values())) == 12


def test_documents_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert classes(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_agreement_estimates_similarity():
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}" for _ in range(400)]
    other = words[:300] + [f"v{rng.randrange(50)}" for _ in range(100)]
    lines = [normal(" ".join(x)) for x in (words, other)]
    row, h, n = shingles(lines)
    sets = [{"h": h[row == k], "n": n[row == k]} for k in (0, 1)]
    sig = signatures(2, row, h, n)
    assert abs((sig[0] == sig[1]).mean() - similarity_of(*sets)) < 4 * np.sqrt(0.25 / COMPONENTS)


def test_weighted_similarity_by_hand():
    a = {"h": np.array([1, 2], np.uint64), "n": np.array([2.0, 1.0])}
    b = {"h": np.array([1, 2], np.uint64), "n": np.array([1.0, 1.0])}
    # 1 / (max(1, 1) + max(1/2, 1)) + 1 / (max(2, 1) + max(1, 1))
    assert near_dedup.probability_jaccard(a, b) == pytest.approx(1 / 2 + 1 / 3)
    assert similarity_of(a, b) == pytest.approx(1.0)  # the plain one is larger


def test_probability_jaccard_equals_its_definition():
    rng = random.Random(4)
    for _ in range(30):
        x, y = ({k: float(rng.randint(1, 5)) for k in range(9) if rng.random() < 0.7} for _ in range(2))
        want = sum(1 / sum(max(x.get(z, 0) / x[k], y.get(z, 0) / y[k]) for z in {*x, *y}) for k in {*x} & {*y})
        a, b = ({"h": np.array(sorted(d), np.uint64), "n": np.array([d[k] for k in sorted(d)])} for d in (x, y))
        assert near_dedup.probability_jaccard(a, b) == pytest.approx(want)


def test_recall_of_bands_and_screen_at_the_threshold():
    rng = random.Random(9)
    shared_band = promising = total = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        other = words[:270] + [f"v{rng.randrange(10**6)}" for _ in range(34)]  # 266 of 334 shingles: 0.796
        row, h, n = shingles([normal(" ".join(x)) for x in (words, other)])
        a, b = signatures(2, row, h, n)
        bands = [near_dedup._buckets(x.astype(np.uint16)) for x in (a, b)]
        shared_band += bool((bands[0] == bands[1]).any())
        promising += (a == b).mean() >= PROMISING
        total += 1
    assert shared_band >= 0.995 * total and promising >= 0.995 * total


def test_blocks_of_small_buckets_and_large_ones_agree(spark, monkeypatch):
    rng = random.Random(13)
    seed = make_text(rng, 150).split()
    rows = []
    for k in range(150):  # near a base text that is not there: links among them are few and cross classes
        own = list(seed)
        for _ in range(2 + k % 3):
            own[rng.randrange(150)] = f"edit{k}x{rng.randrange(9)}"
        rows.append((k, " ".join(own), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert classes(df) == want
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    assert classes(df) == want


def test_an_id_with_several_texts_is_one_document(spark):
    rng = random.Random(21)
    texts = [make_text(rng, 50) for _ in range(4)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (9, texts[1]), (7, texts[2]), (8, texts[3])]
    rows = [(i, t, None, None, None) for i, t in rows]
    assert classes(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == {5: 5, 7: 5, 8: 8, 9: 5}


def test_keep_one_keeps_other_columns(spark, odd, empty):
    wide = odd.withColumn("class_id", odd.lang).withColumn("key", odd.lang)
    kept = keep_one(wide, near_classes(odd))
    assert kept.columns == wide.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for i, c in classes(odd).items() if i == c}
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want)
    assert near_classes(empty).count() == 0 and keep_one(empty, near_classes(empty)).count() == 0


def test_keep_one_makes_the_same_choice_again(spark):
    rows = [(5, t, "en", s, n) for t in ("b b", "a a", "a a") for s in ("x", None) for n in (3, 2)] + [(7, "c", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for n in (1, 4):
        dealt = df.repartition(n)
        got = [tuple(r)[:5] for r in keep_one(dealt, near_classes(dealt)).orderBy("doc_id").collect()]
        assert got == [(5, "a a", "en", "x", 2), (7, "c", None, None, None)]
