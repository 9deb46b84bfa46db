"""Each stage of the pipeline against brute force on the stage's own input."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from weftline.llm.queries import SEQUENCE_IDS, tokenizer_file
from weftline.sources import read_table

from .test_near_dedup import brute as brute_classes
from .test_small_operators import water_fill
from .test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows that each stage got and gave."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = read_table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return out


def test_stages_keep_the_columns_of_documents(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_good_and_drops_bad(spark, steps):
    kept = {r["doc_id"] for r in steps[0][1].collect()}
    labels = read_table(spark, SF, "labels").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_near_dedup_keeps_one_of_each_class(steps):
    before, after = steps[1]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for c in classes.values()})


def test_suffix_dedup_leaves_what_brute_force_leaves(steps):
    before, after = steps[2]
    want = {r[0]: r[4] for r in brute_repeats([(r["doc_id"], r["text"]) for r in before.collect()])}
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == set(want)
    same = sum(hashlib.sha256(r["text"].encode()).hexdigest() == want[i] for i, r in got.items())
    assert same >= 0.95 * len(got)  # the others lost part of a character, which goes as a whole
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_mixing_takes_copies_near_the_targets(steps):
    before, after = steps[3]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before.collect():
        n = len(r["text"].split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in after.collect():
        taken[r["source"]] += len(r["text"].split())
    target = water_fill(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], largest[s]), s


def test_packing_holds_every_document_once_each_copy(steps):
    from tokenizers import Tokenizer

    before, after = steps[4]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for r in before.collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, fill = Counter(), defaultdict(int)
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert got == want and max(fill.values()) <= SEQUENCE_IDS
    assert len(fill) <= 1.02 * -(-sum(got.values()) // SEQUENCE_IDS) + 1


def test_run_gives_the_last_stage(spark, steps):
    rows = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert rows == {tuple(r) for r in steps[-1][1].select("doc_id", "piece", "length", "ids_crc32").collect()}


def _through(spark, docs, folder, monkeypatch):
    """All stages on a table of one's own, none rejected for its quality."""
    monkeypatch.setattr(corpus_pipeline, "keep_good", lambda d, model: d)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or made.columns == docs.columns
        docs = made
    return docs


def test_odd_rows_and_clashing_names_pass_all_stages(spark, odd, tmp_path, monkeypatch):
    names = ("sha", "ord", "raw", "spans", "key", "class_id", "size", "copies", "length", "quality", "h", "score")
    wide = odd.withColumns({c: odd.lang for c in names})
    out = _through(spark, wide, tmp_path, monkeypatch).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert out and max(fill.values()) <= SEQUENCE_IDS


def test_an_empty_table_passes_all_stages(spark, empty, tmp_path, monkeypatch):
    assert _through(spark, empty, tmp_path, monkeypatch).count() == 0
