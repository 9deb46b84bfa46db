from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import suffix_dedup
from weftline.llm.suffix_array import sort_many, sort_one
from weftline.llm.suffix_dedup import LAST, remove_repeats, repeat_digests, smallest_ids
from weftline.sources import read_table

from .conftest import SCHEMA, make_text, odd_rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5))
def test_suffix_arrays_equal_sorting(strings):
    strings = [[*s, 0] for s in strings]
    edges = np.cumsum([0, *map(len, strings)])
    got = sort_many(np.array([c for s in strings for c in s]), edges)
    for k, s in enumerate(strings):
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert (got[edges[k] : edges[k + 1]] - edges[k]).tolist() == want
        assert sort_one(s) == want


def brute(rows, length=50):
    least = {}
    docs = [(LAST if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for i, b in sorted(docs, key=lambda d: d[0]):
        for k in range(len(b) - length + 1):
            least.setdefault(b[k : k + length], i)
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        out.append((None if i == LAST else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_digests(df).collect()]
    return sorted(found, key=str)


def test_odd_rows(odd):
    assert digests(odd) == brute(odd_rows())


def test_documents_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert digests(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_common_seeds_give_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMMON", 2)
    monkeypatch.setattr(suffix_dedup, "LONG", 100)
    assert digests(odd) == brute(odd_rows())


def test_seeds_that_are_not_counted_give_the_same(spark, monkeypatch):
    """A passage that most texts have, within different texts."""
    rng = random.Random(6)
    passage, other = make_text(rng, 25), make_text(rng, 14)
    rows = [(k, f"{make_text(rng, k % 20)} {passage} {make_text(rng, k % 7)}{other if k % 4 == 0 else ''}", "en", "s", 0) for k in range(300)]
    rows += [(k, rows[k % 300][1], "en", "s", 0) for k in range(300, 340)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    monkeypatch.setattr(suffix_dedup, "COMMON", 60)
    for sample in (1 << 26, 1 << 13):
        monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
        monkeypatch.setattr(suffix_dedup, "OFTEN", 10)
        texts = suffix_dedup._texts(df, "doc_id", "text")
        assert len(suffix_dedup._frequent_seeds(texts, 340, 60_000, 50, 1)) > 0
        assert digests(df) == want


def test_smallest_ids_of_strings():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 90))) for _ in range(6)]
    texts = list(dict.fromkeys([*texts, texts[0][:70] + b"zzz", b"q" + texts[1][5:75]]))
    ids = np.array([rng.randrange(100) for _ in texts], np.int64)
    got = smallest_ids(texts, [9] * len(texts), ids, 50)
    for t, own in zip(texts, got, strict=True):
        for k, v in enumerate(own):
            assert v == min(i for u, i in zip(texts, ids, strict=True) if t[k : k + 50] in u)


def test_empty_table_and_other_columns(odd, empty):
    assert repeat_digests(empty).count() == 0
    wide = odd.withColumn("ord", odd.lang).withColumn("spans", odd.lang)
    left = remove_repeats(wide)
    assert left.columns == wide.columns and left.count() == wide.count()
    kept = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in left.where("doc_id = 500").collect()}
    assert kept == {r[4] for r in brute(odd_rows()) if r[0] == 500}
