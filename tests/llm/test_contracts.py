"""The numbered queries against what their contracts state, computed plainly over the whole of the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import packing
from weftline.llm.queries import QUERIES, SEQUENCE_IDS, tokenizer_file
from weftline.operators.nearest import exact_nearest
from weftline.sources import read_table

SF = "/root/testdata/sf0.001"


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in read_table(spark, SF, "documents").collect()]


def test_op1_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for conv, turn, role, text in [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by[conv].append((turn, role, text or ""))
    want = {}
    for conv, own in by.items():
        own.sort()
        learned = "".join(t for _, role, t in own if role == "assistant")
        want[conv] = (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)), len(learned), sha(learned))
    columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    got = {r["conv_id"]: tuple(r[c] for c in columns) for r in QUERIES["op1_budgeted_windows"](spark, SF).collect()}
    assert got == want


def test_op6_payloads(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op6_signature_sniffing"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), sha(payload))
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] >= len(payload) and len(r["media_sha256"]) == 64


def test_op7_base_columns(spark, docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r["doc_id"]: r for r in QUERIES["op7_fuzzy_notices"](spark, SF).collect()}
    hits = 0
    for d in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        starts, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(starts), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        hits += bool(labels)
    assert hits > 1


def test_op8_pieces_and_sequences(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    want, counts = set(), defaultdict(int)
    for d in docs:
        ids = [*whole.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), SEQUENCE_IDS):
            part = ids[k : k + SEQUENCE_IDS]
            want.add((d["doc_id"], k // SEQUENCE_IDS, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            counts[len(part)] += 1
    rows = QUERIES["op8_bin_completion"](spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= SEQUENCE_IDS
    assert len(sequences) == packing.lower_bound(dict(counts), SEQUENCE_IDS)


def test_op9_sizes_targets_and_bounds(spark, docs):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not above:
            break
        full |= above
    taken = defaultdict(int)
    for r in QUERIES["op9_pivotal_mixing"](spark, SF).collect():
        own = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[own]
        assert r["target"] == pytest.approx(target[own]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[own] += r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)


def test_op10_recall_against_the_exact_search(spark):
    table = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in exact_nearest(table, F.col("vec_id") % 20 == 0).collect()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in QUERIES["op10_anisotropic_search"](spark, "/root/testdata/sf0.1").collect()}
    both = exact.keys() & got.keys()
    assert len(got) == len(exact) and len(both) >= 0.9 * len(exact)
    assert all(got[p] == pytest.approx(exact[p], abs=1e-12) for p in both)
