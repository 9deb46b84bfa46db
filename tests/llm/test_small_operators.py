"""Sharding, media, licences, packing, mixing and nearest neighbours against brute force."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import io
import math
import random
import struct
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import license_scan, media, packing
from weftline.llm.ann import search
from weftline.llm.mixing import apply_mix, plan_mix
from weftline.llm.queries import tokenizer_file
from weftline.llm.sharding import assign_shards, write_shards
from weftline.sources import read_table

from .conftest import SCHEMA, make_text, odd_rows

# sharding


def shards(df, limit):
    out = defaultdict(list)
    for r in assign_shards(df, limit).collect():
        out[r["shard"]].append((r["doc_id"], r["n_bytes"], r["depth"]))
    return out


def test_shards_fit_and_split_only_when_needed(spark):
    rng = random.Random(2)
    rows = [(k, "x" * rng.choice([0, 10, 300, 900]), "en", "s", 0) for k in range(600)]
    got = shards(spark.createDataFrame(rows, SCHEMA), 2000)
    assert sum(map(len, got.values())) == 600
    assert all(sum(n for _, n, _ in s) <= 2000 for s in got.values())
    bits = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in range(600)}
    size = {k: len(r[1]) for k, r in enumerate(rows)}
    for name, members in got.items():
        depth = members[0][2]
        if depth:  # its parent was too large
            parent = bits[members[0][0]] >> (60 - depth + 1)
            assert sum(size[k] for k in size if bits[k] >> (60 - depth + 1) == parent) > 2000, name


def test_shards_of_odd_rows(odd, empty, spark):
    got = shards(odd, 3000)
    assert sum(map(len, got.values())) == odd.count()
    assert all(len(s) == 1 or sum(n for _, n, _ in s) <= 3000 for s in got.values())
    assert shards(empty, 100) == {}
    same = spark.createDataFrame([(1, "y" * 100, "en", "s", 0)] * 500, SCHEMA)  # bits can't tell these apart
    got = shards(same, 1000)
    assert sum(map(len, got.values())) == 500 and all(sum(n for _, n, _ in s) <= 1000 for s in got.values())


def test_a_large_row_leaves_the_other_pages_full(spark):
    rows = [(1, "y" * 100, "en", "s", 0)] * 400 + [(1, "z" * 5000, "en", "s", 0), (1, "z" * 900, "en", "s", 0)]
    got = shards(spark.createDataFrame(rows, SCHEMA), 1000)
    assert sum(map(len, got.values())) == 402
    assert all(len(s) == 1 or sum(n for _, n, _ in s) <= 1000 for s in got.values())
    assert len(got) <= 2 + 2 * 40 + 1


def test_written_shards_hold_every_row_as_often_as_it_occurs(spark, odd, tmp_path):
    rows = odd_rows() + [(1, "y" * 100, "en", "s", 0)] * 50 + [(2, "only", None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("page", F.col("lang"))
    docs = docs.withColumn("h", F.lit(1)).withColumn("row", F.lit(2)).withColumn("content", F.col("text"))
    plan = write_shards(docs, f"{tmp_path}/out", 1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    as_rows = lambda df: Counter(tuple(r) for r in df.select(*docs.columns).collect())
    assert back.columns == [*docs.columns, "_shard"] and as_rows(back) == as_rows(docs)
    per_shard = Counter(r["_shard"] for r in back.collect())
    assert per_shard == Counter(r["shard"] for r in plan.collect())


def test_written_shards_keep_rows_that_differ_in_little(spark, tmp_path):
    """Microseconds, the sign of zero, NaN, maps, nested nulls; names that differ from the folder's in case only."""
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "y" * 50, at + dt.timedelta(microseconds=k), 0.0, {"a": k % 2}, (None, [k])) for k in range(5)]
    rows += [(1, "y" * 50, at, x, {"a": None}, None) for x in (0.0, -0.0, float("nan"), None)] * 2
    schema = "doc_id long, text string, at timestamp_ntz, x double, m map<string, int>, s struct<a: int, b: array<int>>"
    docs = spark.createDataFrame(rows, schema).withColumn("Shard", F.lit(1)).withColumn("ROW", F.lit(2)).withColumn("held", F.lit(3))
    write_shards(docs.repartition(2), f"{tmp_path}/out", 120)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*docs.columns, "_shard"]
    assert Counter(str(tuple(r)) for r in back.drop("_shard").collect()) == Counter(str(tuple(r)) for r in docs.collect())
    assert Counter(math.copysign(1, r["x"]) for r in back.collect() if r["x"] == 0) == {1.0: 7, -1.0: 2}


# media


def png() -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_sniffer_confirms_carves_and_rejects():
    packed = gzip.compress(b"hello")
    assert media.sniff(png()) == [("image/png", 0, len(png()))]
    assert media.sniff(GIF) == [("image/gif", 0, len(GIF))]
    blob = b"BM junk PK\x03\x04" + packed + b"..." + png() + b"RIFF"
    assert media.sniff(blob) == [("application/gzip", 11, len(packed)), ("image/png", 14 + len(packed), len(png()))] or media.sniff(blob)[0][1] == blob.find(packed)
    broken = bytearray(png())
    broken[-6] ^= 1
    assert media.sniff(bytes(broken)) == [] and media.sniff(None) == [] and media.sniff(b"") == []


def test_values_full_of_magic_bytes_cost_their_length():
    begin = time.monotonic()
    for unit in (b"PK\x03\x04PK\x05\x06", b"%PDF-1", b"\xff\xd8\xff\xda\x00\x02", b"GIF89a" + b"\x01" * 7 + b"," + b"\x01" * 20, b"BM", b"\x1f\x8b\x08", b"RIFF"):
        assert media.sniff(unit * (400_000 // len(unit))) == []
    assert time.monotonic() - begin < 30


def plain_riff(b, at):
    end, form = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), b[at + 8 : at + 12]
    if len(b) < at + 12 or end > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    p, seen = at + 12, []
    while p + 8 <= end:
        seen.append(b[p : p + 4])
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    if p not in (end, end + 1):
        return None
    if form == b"WEBP":
        return end if seen and seen[0] in (b"VP8 ", b"VP8L", b"VP8X") else None
    return end if b"fmt " in seen and b"data" in seen and seen.index(b"fmt ") < seen.index(b"data") else None


def test_chains_of_chunks_equal_walking_them():
    rng, good = random.Random(1), 0
    for _ in range(1500):
        b = bytearray()
        for _ in range(rng.randint(1, 12)):
            n = rng.choice([0, 1, 2, 4, 12, 20])
            head = b"RIFF" + rng.choice([4, 12, 13, 20, 28, 36, 44, 60, 100]).to_bytes(4, "little") + rng.choice([b"WAVE", b"WEBP", b"XXXX"])
            chunk = rng.choice([b"fmt ", b"data", b"VP8 ", b"abcd"]) + n.to_bytes(4, "little") + bytes(rng.choice([n, n + n % 2]))
            b += head if rng.random() < 0.4 else chunk
        value = media.Value(bytes(b))
        places = [m for m in range(len(b)) if b[m : m + 4] == b"RIFF"]
        rng.shuffle(places)
        for at in places:
            want = plain_riff(value.raw, at)
            assert media._riff(value, at) == want
            good += want is not None
    assert good > 5


def test_a_long_chain_with_a_header_in_each_chunk_takes_little_time():
    n = 1_000_000 // 20
    unit = [b"abcd" + (12).to_bytes(4, "little") + b"RIFF" + (20 * (n - i) - 16).to_bytes(4, "little") + b"WAVE" for i in range(n)]
    begin = time.monotonic()
    assert media.sniff(b"".join(unit)) == [] and time.monotonic() - begin < 5


def test_checksums_of_parts_equal_zlib():
    rng = random.Random(3)
    value = media.Value(rng.randbytes(60_000))
    for _ in range(200):
        a, b = sorted(rng.randrange(60_001) for _ in range(2))
        assert value.crc(a, b) == zlib.crc32(value.raw[a:b])


def test_archives_documents_and_nested_media():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.png", png())
        z.writestr("b.txt", "text " * 50)
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    blob = b"junk" + packed.getvalue() + b"junk" + pdf + GIF
    found = media.sniff(blob)
    archive = len(packed.getvalue())
    assert ("application/zip", 4, archive) in found and ("image/png", blob.index(png()), len(png())) in found
    assert ("application/pdf", 8 + archive, len(pdf)) in found and ("image/gif", 8 + archive + len(pdf), len(GIF)) in found


def test_features_carve_and_correct_stored_texts(spark, odd, empty):
    rows = [(1, "plain text", None, None, 0), (2, "PK\x03\x04 no archive", None, None, 0), (3, None, None, None, 0)]
    wide = spark.createDataFrame(rows, SCHEMA).withColumn("media", F.lit("x")).withColumn("declared", F.lit(1))
    got = {r["doc_id"]: r for r in media.media_features(media.texts_to_media(wide)).collect()}
    assert {r["media_type"] for r in got.values()} == {"audio/wav"} and all(r["n_carved"] == len(r["carved"]) == 0 for r in got.values())
    assert all(r["corrected"] == (r["declared"] != "audio/wav") for r in got.values())
    stored = spark.createDataFrame([(7, 3, bytearray(media.store_text("GIF") + GIF), None)], media.MEDIA_SCHEMA)
    held = media.media_features(stored).first()
    assert (held["corrected"], [tuple(c) for c in held["carved"]]) == (True, [("image/gif", len(media.store_text("GIF")), len(GIF))])
    assert media.sniff(b"pad" + GIF) == [("image/gif", 3, len(GIF))]
    assert media.media_features(media.texts_to_media(empty)).count() == 0


def test_declared_types_are_corrected(spark):
    rows = [(1, "image/jpeg", bytearray(png())), (2, "image/png", bytearray(png())), (3, "image/png", bytearray(b"text")), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, declared string, content binary")
    got = {r["id"]: (r["found"], r["corrected"]) for r in media.sniff_column(df, "content", "declared", "id").collect()}
    assert got == {1: ("image/png", True), 2: ("image/png", False), 3: (None, False), 4: (None, False)}


def test_texts_come_back_from_media(odd, empty):
    got = media.media_features(media.texts_to_media(odd)).collect()
    want = Counter()
    for r in odd_rows():
        raw = (r[1] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(r[0], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["media_type"] == "audio/wav" and r["media_bytes"] == 44 + r["payload_bytes"] for r in got)
    assert media.media_features(media.texts_to_media(empty)).count() == 0


# licences


def brute_base(text):
    words = license_scan.words_of(text)
    found = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.encode().split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), found


def test_licences_of_odd_rows(odd, empty):
    got = license_scan.scan_licenses(odd).collect()
    assert len(got) == odd.count()
    by_text = Counter()
    for r in odd_rows():
        n, found = brute_base(r[1])
        at = [k for k, _ in found]
        by_text[(r[0], n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == by_text
    assert all(0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_edited_notices_are_found(edits):
    rng = random.Random(edits)
    for notice, label, most in license_scan.NOTICES:
        if edits > most:
            continue
        for _ in range(20):
            text = list(notice)
            for _ in range(edits):
                at = rng.randrange(1, len(text) - 1)
                rng.choice([lambda t=text, a=at: t.pop(a), lambda t=text, a=at: t.insert(a, "q"), lambda t=text, a=at: t.__setitem__(a, "q")])()
            joined = "before " + "".join(text) + " after"
            assert label in {s[0] for s in license_scan.fuzzy_spans(joined)}, joined


def test_neighbouring_notices_are_all_found():
    notice = "licensed under the mit license"
    texts = ["licensed under the mlt license", notice, "licnsed under the mit license"]
    joined = "a " + " or ".join(texts) + " b"
    found = [(s, e, k) for label, s, e, k in license_scan.fuzzy_spans(joined, ((notice, "mit", 3),))]
    assert found == [(joined.index(t), joined.index(t) + len(t), k) for t, k in zip(texts, (1, 0, 1), strict=True)]
    got = license_scan.scan_text(joined, license_scan.PHRASES, ((notice, "mit", 3),))
    assert [(x["start_word"], x["n_words"], x["edits"]) for x in got["spans"]] == [(1, 5, 1), (7, 5, 0), (13, 5, 1)]
    assert (got["n_base"], got["first_word"], got["last_word"]) == (2, 8, 14)


def test_fuzzy_search_equals_matching_over_the_whole_text(spark):
    """The pigeonhole search against the bounded-error pattern of each notice run over everything."""
    rng = random.Random(17)
    notices = license_scan.NOTICES
    texts = [r["text"][:3000] for r in read_table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    for _ in range(40):
        parts = [make_text(rng, rng.randint(0, 12))]
        for _ in range(rng.randint(1, 3)):
            notice = list(rng.choice(notices)[0])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(notice))
                notice[at] = rng.choice(["", "x", notice[at] + "q"])
            parts += ["".join(notice), make_text(rng, rng.randint(1, 9))]
        texts.append(" ".join(parts))
    hits = 0
    for text in texts:
        joined = b" ".join(license_scan.words_of(text)).decode("utf-8", "surrogatepass")
        _, patterns = license_scan._searcher(notices)
        want = {(notices[w][1], m.start()) for w, p in enumerate(patterns) for m in p.finditer(joined)}
        got = {(label, start) for label, start, _, _ in license_scan.fuzzy_spans(joined, notices)}
        assert {x[0] for x in got} == {x[0] for x in want}, text
        hits += len(want)
    assert hits > 40


def test_scans_of_a_table_with_clashing_names(odd, empty):
    wide = odd.withColumn("labels", F.lit(1)).withColumn("spans", F.col("text")).withColumn("score", F.lit("x"))
    got = sorted((tuple(r) for r in license_scan.scan_licenses(wide).collect()), key=str)
    assert got == sorted((tuple(r) for r in license_scan.scan_licenses(odd).collect()), key=str)
    assert len(got) == odd.count() and license_scan.scan_licenses(empty).count() == 0


def test_clean_text_has_no_label():
    assert license_scan.scan_text(make_text(random.Random(0), 5000), license_scan.PHRASES, license_scan.NOTICES)["labels"] == ""


# packing


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    whole, ours = Tokenizer.from_file(path), packing.WordIds(path)
    texts = [r[1] or "" for r in odd_rows()] + ["It's we'll ÀÉ ÿ ñ 12345 ½ ª ß İ é  x y\x85z\x1cq <|endoftext|> 'S", "日本語 text—dash… ¡hola! #*$%"]
    for t in texts:
        assert ours.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def best_possible(sizes, capacity):
    """Fewest bins by trying everything."""
    best = len(sizes)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for k, b in enumerate(bins):
            if b + rest[0] <= capacity and b not in bins[:k]:
                place(rest[1:], [*bins[:k], b + rest[0], *bins[k + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
    solution = packing.pack_histogram(dict(Counter(sizes)), 20)
    used = Counter()
    for filling, times in solution:
        assert sum(filling) <= 20
        for s in filling:
            used[s] += times
    assert used == Counter(sizes)
    assert sum(n for _, n in solution) == best_possible(sizes, 20)


def fewest_bins(sizes, capacity):
    """By dynamic programming over sets of pieces: fewest full bins, then the least in the open one."""
    best = [(0, capacity)] + [None] * ((1 << len(sizes)) - 1)
    for held in range(1, 1 << len(sizes)):
        ways = []
        for k, s in enumerate(sizes):
            if held >> k & 1:
                n, fill = best[held ^ (1 << k)]
                ways.append((n, fill + s) if fill + s <= capacity else (n + 1, s))
        best[held] = min(ways)
    return best[-1][0]


@pytest.mark.parametrize("seed", range(20))
def test_without_limits_the_packing_is_optimal(seed):
    rng = random.Random(100 + seed)
    capacity = rng.choice([30, 100])
    sizes = [rng.randint(capacity // 8, capacity * 2 // 3) for _ in range(14)]
    counts = dict(Counter(sizes))
    solution = packing.pack_histogram(counts, capacity, breadth=None, nodes=None)
    used = Counter()
    for filling, times in solution:
        assert sum(filling) <= capacity
        for s in filling:
            used[s] += times
    assert used == Counter(sizes) and sum(n for _, n in solution) == fewest_bins(sizes, capacity)
    limited = packing.packing_report(counts, packing.pack_histogram(counts, capacity), capacity)
    assert limited["lower_bound"] <= fewest_bins(sizes, capacity) <= limited["sequences"]


def test_packing_meets_the_lower_bound_of_the_tables(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    lengths = packing.cut_pieces(docs, tokenizer_file(), 2048, "doc_id", "text").groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in lengths}
    first = packing.packing_report(counts, packing.pack_histogram(counts, 2048, *packing.WIDTHS[0]), 2048)
    best = packing.packing_report(counts, packing.search(counts, 2048), 2048)
    assert first == {"sequences": 443, "lower_bound": 442} and best == {"sequences": 442, "lower_bound": 442}
    assert packing.search({}, 2048) == []


def test_every_undominated_filling_is_enumerated():
    assert packing.all_completions(10, {7: 1, 5: 2, 3: 1, 2: 2}) == [(7, 3), (5, 5)]
    assert packing.all_completions(4, {5: 1}) == [()] and packing.all_completions(6, {3: 1, 2: 5}) == [(2, 2, 2), (3, 2)]


def test_packing_of_clashing_names(odd):
    wide = odd.withColumn("length", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("row", F.lit(2)).withColumn("g", F.lit(3))
    count = lambda df: Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pack(df, tokenizer_file(), 64).collect())
    assert count(wide) == count(odd)


def test_packing_of_odd_rows(spark, odd, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    got = packing.pack(odd, tokenizer_file(), 64).collect()
    want = Counter()
    for r in odd_rows():
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(r[0], k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, tokenizer_file(), 64).count() == 0


# mixing


def water_fill(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    left = float(total)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([1, 5, 20, 300]), "en", None if k % 50 == 0 else rng.choice(["a", "é", "b", "c", "c", "c", "c"]), 0) for k in range(3000)]
    rows += [(9000, "w " * 20000, "en", "c", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = plan_mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    target = water_fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s], (s, taken[s], target[s])
    again = plan_mix(df.repartition(7)).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_mix_keeps_expected_copies(spark):
    rows = [(k, "w " * (1 + k % 9), "en", "abc"[k % 3], 0) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    total = Counter()
    for seed in range(12):
        for r in plan_mix(df, seed=seed).collect():
            total[r["source"]] += r["copies"] / 12
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"}
    target = water_fill(sizes)
    for s in "abc":
        assert total[s] == pytest.approx(40 * target[s] / sizes[s], abs=4)


def test_mix_of_odd_rows(odd, empty):
    plan = plan_mix(odd)
    assert plan.count() == odd.count() and plan_mix(empty).count() == 0
    wide = odd.withColumn("copies", F.lit("x")).withColumn("size", F.lit(1))
    out = apply_mix(wide, plan)
    assert out.columns == wide.columns and out.count() == plan.agg(F.sum("copies")).first()[0]


def test_rows_without_ids_get_their_own_copies(spark):
    rows = [(None, f"s{k % 3} n{k} " + "w " * (k % 40), "en", "abc"[k % 3], k) for k in range(900)]
    rows += [(7, f"same {k % 5}", "en", "c", k) for k in range(60)]  # one id, equal rows but for n_chars
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    plan = plan_mix(df).cache()
    want = Counter()
    for r in plan.collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got, each = Counter(), Counter()
    for r in apply_mix(df, plan).collect():
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
        each[r["n_chars"], r["text"]] += 1
    assert got == +want
    assert len({plan_copies for plan_copies in want.values()}) > 1 and max(each.values()) <= 3


def test_mix_of_many_rows_alike_and_a_hot_source(spark):
    n = 9000
    rows = [(None, "same words here", "en", "hot", 0)] * n + [(5, "other words", "en", "hot", 0)] * 700
    rows += [(k, "w " * (1 + k % 30), "en", f"s{k % 4}", 0) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = plan_mix(df).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(r[1].split())) for r in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    target = water_fill(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(31, 0.001 * target[s]), (s, taken[s], target[s])
    again = plan_mix(df.repartition(2)).collect()
    as_rows = lambda rs: Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in rs)
    assert as_rows(got) == as_rows(again)


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(0, 40), "en", f"host{k}.example", 0) for k in range(2500)] + [(-1, "w " * 900, "en", None, 0)]
    got = plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    target = water_fill({r[3]: len(r[1].split()) for r in rows})
    assert len(got) == len(rows) and all(r["target"] == pytest.approx(target[r["source"]]) for r in got)


# nearest neighbours


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and len(v) == 6 and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in ok if j != i))[:k]
    return out


def test_nearest_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 400)]
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0, 0, 0, 0]), (460, [float("nan")] * 6), (461, [float("inf")] * 6), (480, [1.0]), (None, [1.0] * 6)]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("ids", F.lit(2))
    got = defaultdict(list)
    for r in search(df, F.expr("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 5)
    assert set(got) == set(want)
    for i, near in want.items():
        assert [x[0] for x in got[i]] == [1, 2, 3, 4, 5]
        assert [x[1] for x in got[i]] == [j for _, j in near]
        assert np.allclose([x[2] for x in got[i]], [-s for s, _ in near])


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    same = [3.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    rows += [(205, same)] * 30 + [(206, same)]  # a candidate that repeats more often than an answer has rows
    repeated = rows + [r for r in rows if r[0] % 40 == 0] * 3 + rows[50:90]
    got = defaultdict(list)
    df = spark.createDataFrame(repeated, "vec_id long, embedding array<double>").repartition(3)
    for r in search(df, F.expr("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    want = brute_nearest([*rows[:201], rows[-1]], 5)
    assert got == {i: [(n, j) for n, (_, j) in enumerate(near, 1)] for i, near in want.items()}
    assert any(j == 206 for near in got.values() for _, j in near)


def test_exact_search_loses_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]  # no clusters: some neighbours lie in cells that a search would not probe
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in search(df, F.expr("vec_id % 20 = 0"), k=9, rows_a_cell=20, coverage=0.3, rerank=1, exact=True).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {i: [j for _, j in near] for i, near in brute_nearest(rows, 9).items()}


def test_few_candidates_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(few, F.expr("vec_id % 20 = 0")).collect()] == [(0, 1, 1, 1.5)]
    assert search(few.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in search(df, F.expr("vec_id % 20 = 0"), k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in range(0, 3000, 20):
        scores = x.astype(float) @ x[i].astype(float)
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & got[i])
    assert hits / (20 * 150) >= 0.9
