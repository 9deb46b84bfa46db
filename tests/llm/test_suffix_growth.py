"""op4's work follows the bytes of text: answers, groups, and the strings that suffix arrays are built over."""

from __future__ import annotations

import random

import numpy as np

from weftline.llm import suffix_dedup
from weftline.llm.suffix_dedup import LEVELS, SEED, pieces, refined, salted, smallest_by_string

from .conftest import SCHEMA, make_text, odd_rows
from .test_suffix_dedup import brute, digests


def chance_pieces(rng, k):
    """Pieces of texts that share 20 bytes and nothing else."""
    seeds = [bytes(rng.choice(b"abc") for _ in range(SEED)) for _ in range(1000)]
    seed = min(seeds, key=lambda s: suffix_dedup.window_hashes(np.frombuffer(s, np.uint8), SEED)[0])
    found = {}
    while len(found) < k:
        raw = bytes(rng.choice(b"defghi") for _ in range(40)) + seed + bytes(rng.choice(b"defghi") for _ in range(40))
        data = np.frombuffer(raw, np.uint8)
        want = suffix_dedup.window_hashes(np.frombuffer(seed, np.uint8), SEED)[0]
        for _, start, n, own in zip(*(x.tolist() for x in pieces(data, np.array([len(raw)]), 50)), strict=True):
            if own == int(want):
                found[raw[start : start + n + 49]] = n
    strings = list(found)
    return strings, np.array(list(found.values())), np.full(k, want)


def joined(strings):
    return np.frombuffer(b"".join(strings), np.uint8)


def test_strings_that_share_a_seed_by_chance_are_not_sorted(monkeypatch):
    strings, n, seed = chance_pieces(random.Random(3), 120)
    ids = np.arange(len(n))
    monkeypatch.setattr(suffix_dedup, "smallest_ids", None)
    got = smallest_by_string(joined(strings), n, seed, seed, ids, 50, LEVELS)
    assert got.tolist() == np.repeat(ids, n).tolist()


def test_smallest_ids_by_string(monkeypatch):
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 400))) for _ in range(40)]
    texts += [t[rng.randint(0, 30) :] + bytes(rng.choice(b"ab") for _ in range(20)) for t in texts] + [b"a" * 300, b"ab" * 90]
    lengths = np.array([len(t) for t in texts])
    text, start, n, seed = pieces(joined(texts), lengths, 50)
    raw = b"".join(texts)
    own = [raw[a : a + k + 49] for a, k in zip(start.tolist(), n.tolist(), strict=True)]
    want: dict[bytes, int] = {}
    for t, piece in zip(text.tolist(), own, strict=True):
        for k in range(len(piece) - 49):
            want[piece[k : k + 50]] = min(t, want.get(piece[k : k + 50], t))
    for long, hashes in ((4000, suffix_dedup._hashes), (100, suffix_dedup._hashes), (100, lambda data, widths: np.zeros(len(widths), np.uint64))):
        monkeypatch.setattr(suffix_dedup, "LONG", long)
        monkeypatch.setattr(suffix_dedup, "_hashes", hashes)
        which, one = suffix_dedup._laid_down({"data": joined(own), "n": n, "seed": seed, "ords": np.arange(len(texts)), "text": text}, 50)
        least = smallest_by_string(one["data"], one["n"], one["seed"], one["seed"], one["ids"], 50, LEVELS)
        got = least[suffix_dedup._strings_of(one["n"], which)]
        assert got.tolist() == [want[p[k : k + 50]] for p in own for k in range(len(p) - 49)]


def test_longer_seeds_leave_few_strings_in_a_piece():
    strings, n, seed = chance_pieces(random.Random(4), 20)
    piece, first, m, _ = refined(joined(strings), n, seed, 50, suffix_dedup.FINEST)
    assert m.max() <= 2 and m.sum() == n.sum()
    assert [(p, f + k) for p, f, c in zip(piece, first, m, strict=True) for k in range(c)] == [(p, k) for p in range(len(n)) for k in range(n[p])]


def test_a_text_gets_one_answer_however_many_groups_count(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, make_text(rng, 60), "en", "s", 0) for k in range(40)]
    rows += [(40 + k, f"{rows[k][1]} {k}", "en", "s", 0) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    heads = suffix_dedup._heads(suffix_dedup._texts(df, "doc_id", "text"))
    found = suffix_dedup._answers(heads, 50, 16, np.zeros(0, np.uint64)).collect()
    assert len(found) == len({r["sha"] for r in found}) == 80
    assert all(len(r["shared"]) > 0 and not r["common"] for r in found)


def test_salted_groups_follow_the_input():
    for rows, compared in ((50_000, 7), (256_410, 103), (3_000_000, 1236), (15_000_000, 6180), (10**8, 50)):
        groups, salts = salted(rows, compared)
        assert groups * salts <= max(compared, salts) and salts >= rows / suffix_dedup.SALTED


def test_many_groups_and_salts_give_the_same(spark, odd, monkeypatch):
    for name, value in (("COUNTED", 1 << 17), ("COMPARED", 1 << 16), ("SALTED", 200), ("SENT", 1 << 14), ("PART", 1 << 10)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(suffix_dedup, "COMMON", 2)
    assert digests(odd) == brute(odd_rows())


def test_stage_three_of_the_pipeline_with_many_groups_and_salts(spark, odd, monkeypatch):
    """Its salted groups followed the square of the input, and a text had an answer from each group."""
    import corpus_pipeline

    for name, value in (("COUNTED", 1 << 17), ("COMPARED", 1 << 16), ("SALTED", 200), ("SENT", 1 << 14), ("COMMON", 2)):
        monkeypatch.setattr(suffix_dedup, name, value)
    lost = {r[0]: (r[1], r[2]) for r in brute(odd_rows()) if r[0] is not None}
    for r in corpus_pipeline.suffix_dedup(spark, odd, "").where("doc_id is not null").collect():
        n_bytes, removed = lost[r["doc_id"]]
        left = len((r["text"] or "").encode())
        assert n_bytes - removed - 6 * 40 <= left <= n_bytes - removed  # parts of characters go as a whole
        assert r["text"] is None or r["n_chars"] == len(r["text"])
