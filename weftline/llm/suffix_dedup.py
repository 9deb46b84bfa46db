"""Suffix-array dedup: remove bytes of strings that a document with a smaller id has too.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller
id. Strings are compared as they are in the input, and never across documents.

1. Equal texts become one, with its smallest id (map-side combined, so a text that a third of the
   rows share costs nothing). Their other copies lose every byte if they have `length` bytes. The
   distinct texts move once: what follows brings small answers to where each text is, by its
   digest, and Spark reuses that exchange.
2. Each string of `length` bytes has a seed: the 20-byte substring with the smallest hash. Equal
   strings have equal seeds, and neighbouring strings mostly share one, so a text is a row of
   pieces: runs of strings with one seed.
3. Seeds are counted; pieces whose seed occurs in one text only are done. Texts go to the counts in batches, and
   the answers come back by batch, so a text has one answer however many groups count. Seeds that a large part of
   all texts has would crowd one group of the count. A sample of texts shows them beforehand; they are
   not counted but taken as common at once (5). The sample only says how work is dealt, not what is lost.
4. The other pieces meet by seed. Equal pieces are laid down once with their smallest id. Pieces of
   one seed are cut by longer seeds (`refined`), so that those that share a seed by chance part; the
   pieces of a longer seed make one string, and its suffix array (see suffix_array.py) brings equal
   strings next to each other: neighbours that share `length` bytes form a group, and all but the
   group's smallest id lose these bytes.
5. The pieces of a seed that very many texts share don't fit one group. They are cut by nearly whole
   strings, dealt by these, and each such group is salted by batches of texts: a salted group lays equal pieces down
   once, the suffix arrays are built over what the salted groups have left, and the smallest ids go back
   to them. So neither a common seed nor a common string is ever one task's work, and there are as many salted
   groups as the bytes of text ask for.

Lost ranges of a text are merged and cut out where the text is.

Cases: null texts are empty; empty or short texts lose nothing; rows without an id count as having
the largest id; rows that share an id don't take bytes from each other; repeated rows of one id
have the same result each; an empty table gives an empty result; other columns pass through
`remove_repeats` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.suffix_array import sort_many, sort_one

SEED = 20  #: bytes of a seed; a string of `length` bytes holds length - SEED + 1 of them
CHUNK = 1 << 17  #: bytes of text that are cut into pieces at once
SENT = 1 << 22  #: bytes of text whose pieces make one row for each group
COUNTED = 1 << 28  #: bytes of text for whose seeds one group of rows is counted together
COMPARED = 1 << 23  #: bytes of text for whose pieces one group of rows is compared together
PART = 1 << 18  #: bytes of pieces that are hashed, or cut by longer seeds, at once
LEVELS = (2, 4)  #: of longer seeds: before the first comparison, and again for keys that still have more than LONG symbols
FINEST = 4  #: level of the longer seeds of common seeds' pieces: with 50 bytes, a piece has two strings at most
SALTED = 1 << 16  #: texts for which there is one salt
ARRAY = 1 << 22  #: symbols that are sorted at once, except that a seed's are never split
PIECE = 64  #: strings in a piece at most
COMMON = 20_000  #: texts above which a seed's strings are dealt by their own hash
SAMPLE = 1 << 26  #: bytes, about, of the sample of texts that shows which seeds are not to be counted
OFTEN = 50  #: texts of the sample that such a seed is in at least, which bounds their number
LONG = 4000  #: symbols above which a string is sorted by itself
LAST = (1 << 63) - 1  #: stands for the id of rows without one
DIGEST = 16  #: bytes of SHA-256 that name a text

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


@cache
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _all_powers(int(base), 1 << n.bit_length() if n < 2 * CHUNK else n)[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each substring of `width` bytes."""
    n = len(data)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, n), dtype=_U)])
    return _mix((sums[width:] - sums[:-width]) * _powers(_INVERSE, n + 1 - width))


def pieces(data: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The pieces of texts laid end to end: text, start in data, number of strings, hash of the seed."""
    n, span = len(data), length - SEED + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, _U)
    low, width = window_hashes(data, SEED), 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n - length + 1], low[span - width : span - width + n - length + 1])
    ends = np.cumsum(lengths)
    fresh = np.concatenate([[True], low[1:] != low[:-1]])
    for edge in (ends - lengths, ends - np.minimum(lengths, length - 1)):  # of a text, and of its last strings' ends
        fresh[edge[edge < len(fresh)]] = True
    run = np.flatnonzero(fresh)
    n = np.diff(np.append(run, len(fresh)))
    text = np.searchsorted(ends, run, "right")
    whole = run + length <= ends[text]
    run, n, text = run[whole], n[whole], text[whole]
    parts = -(-n // PIECE)
    place = PIECE * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    start = np.repeat(run, parts) + place
    return np.repeat(text, parts), start, np.minimum(np.repeat(n, parts) - place, PIECE), low[start]


def _seeds_by_text(text: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct seeds: text, seed."""
    order = np.lexsort((seed, text))
    t, s = text[order], seed[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])]) if len(s) else np.zeros(0, bool)
    return t[new], s[new]


def _code(seed: np.ndarray, counted: int) -> np.ndarray:
    """What is counted for a seed: its group and 32 bits of it."""
    return (seed % _U(counted) << _U(32)) | (seed >> _U(32))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts (column raw) of about CHUNK bytes: first row, row after the last, bytes, lengths."""
    raw = batch.column("raw").cast(pa.binary())
    _, offsets, values = raw.buffers()
    if not len(raw):
        return
    edges = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if edges[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1)
        yield at, to, data[edges[at] : edges[to]], np.diff(edges[at : to + 1])
        at = to


def _digests(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sha").to_pylist()), f"V{DIGEST}")


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells with the given numbers of values each."""
    offsets = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


KEYS = "bucket int, batch binary, shas binary, owners binary, sizes binary, keys binary, of_known binary, known binary"
_KEYS_ARROW = pa.schema([("bucket", pa.int32()), *[(c.split()[0], pa.binary()) for c in KEYS.split(", ")[1:]]])


def _frequent_seeds(texts: DataFrame, rows: int, total: int, length: int, counted: int) -> np.ndarray:
    """Codes of seeds that a sample of the texts (ord, raw) lets expect in COMMON texts or more, in order."""
    every = 1 + total // SAMPLE
    if rows < COMMON:
        return np.zeros(0, _U)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, lengths in _chunks(batch):
                text, _, _, seed = pieces(data, lengths, length)
                _, seed = _seeds_by_text(text, seed)
                yield pa.RecordBatch.from_arrays([pa.array(_code(seed, counted).view(np.int64))], names=["code"])

    sample = texts.where(F.pmod(F.xxhash64("raw"), F.lit(every)) == 0)
    one = sample.groupBy(_digest(F.col("raw")).alias("sha")).agg(F.max("raw").alias("raw"))
    found = one.mapInArrow(codes, "code long").groupBy("code").count().where(F.col("count") >= max(OFTEN, -(-COMMON // every)))
    return np.sort(np.array([r["code"] for r in found.collect()], np.int64).view(_U))


def _count_rows(length: int, counted: int, frequent):
    """Batches of texts to 32 bits of their distinct seeds, by group: places of texts in the batch, seeds of each, seeds.

    A batch is named by its first text. Its first row also has the digests of its texts, and their seeds that are known
    to be frequent (a broadcast) and not counted.
    """

    def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        sha, owner, code = (np.concatenate(x) for x in zip(*held, strict=True))
        known = _among(code, frequent.value)
        first = {"shas": sha.tobytes(), "of_known": owner[known].tobytes(), "known": code[known].tobytes()}
        owner, code = owner[~known], code[~known]
        bucket = (code >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        owner, code, bucket = owner[order], code[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(code) else np.zeros(2, np.int64)
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            new = np.flatnonzero(np.diff(owner[a:b].astype(np.int64), prepend=-1))
            row = {
                "bucket": int(bucket[a]) if b > a else 0,
                "batch": sha[0].tobytes(),
                "owners": owner[a:b][new].tobytes(),
                "sizes": np.diff(np.append(new, b - a)).astype(np.int32).tobytes(),
                "keys": (code[a:b] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
            }
            out.append({"shas": b"", "of_known": b"", "known": b""} | row | (first if not out else {}))
        return pa.RecordBatch.from_pylist(out, schema=_KEYS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for batch in batches:
            shas = _digests(batch)
            for at, to, data, lengths in _chunks(batch):
                text, _, _, seed = pieces(data, lengths, length)
                text, seed = _seeds_by_text(text, seed)
                held.append((shas[at:to], (text + texts).astype(np.uint32), _code(seed, counted)))
                texts += to - at
                size += len(data)
                if size >= SENT:
                    yield rows(held)
                    held, size, texts = [], 0, 0
        if held:
            yield rows(held)

    return run


COUNTS = "batch binary, shas binary, owners binary, shared binary, of_common binary, common binary"


def _count(common: int):
    """Per group of seeds: for each batch the seeds that several texts have, and those that very many have, with their texts."""

    def run(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"].to_pylist()])
        keys.sort()
        again = keys[1:] == keys[:-1]
        begins = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]])[: len(again)])
        n = np.flatnonzero(again & ~np.append(again[1:], False)[: len(again)]) - begins + 2
        found = keys[begins]
        many = found[n > common]
        del keys, again
        high = _U(group["bucket"][0].as_py() << 32)
        out: dict[str, list] = {c.split()[0]: [] for c in COUNTS.split(", ")}
        for row in (x for b in group.to_batches(max_chunksize=16) for x in b.to_pylist()):
            own = np.frombuffer(row["keys"], np.uint32)
            owner = np.repeat(np.frombuffer(row["owners"], np.uint32), np.frombuffer(row["sizes"], np.int32))
            some = _among(own, found)
            own, owner = own[some], owner[some]
            often = _among(own, many)
            code = own.astype(_U) | high
            out["batch"].append(row["batch"])
            out["shas"].append(row["shas"])
            out["owners"].append(owner[~often].tobytes())
            out["shared"].append(code[~often].tobytes())
            out["of_common"].append(row["of_known"] + owner[often].tobytes())
            out["common"].append(row["known"] + code[often].tobytes())
        return pa.table({c: pa.array(x, pa.binary()) for c, x in out.items()})

    return run


ANSWERS = "sha binary, shared binary, common binary"


def _by_text(group: pa.Table) -> pa.Table:
    """Per batch of texts: the seeds of each text that several texts have, and those that very many have."""
    c = {k: b"".join(group[k].to_pylist()) for k in group.column_names if k != "batch"}
    shas = np.frombuffer(c["shas"], f"V{DIGEST}")
    cells, counts = [], []
    for owners, codes in (("owners", "shared"), ("of_common", "common")):
        owner = np.frombuffer(c[owners], np.uint32)
        cells.append(np.frombuffer(c[codes], _U)[np.argsort(owner, kind="stable")])
        counts.append(np.bincount(owner, minlength=len(shas)))
    some = np.flatnonzero(counts[0] + counts[1])
    named = pa.array([x.tobytes() for x in shas[some]], pa.binary())
    shared, common = (_ragged(x, n[some]) for x, n in zip(cells, counts, strict=True))
    return pa.table({"sha": named, "shared": shared, "common": common})


def _among(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of x are in found (in order), a part of x at a time."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x) if len(found) else 0, 1 << 20):
        part = x[at : at + (1 << 20)]
        out[at : at + len(part)] = found[np.minimum(np.searchsorted(found, part), len(found) - 1)] == part
    return out


PIECES = (
    "bucket int, salt int, shas binary, ords binary, sizes binary, start binary, strings binary, seed binary, data binary"
)
_PIECES_ARROW = pa.schema(
    [("bucket", pa.int32()), ("salt", pa.int32())]
    + [(c, pa.binary()) for c in ("shas", "ords", "sizes", "start", "strings", "seed", "data")]
)


def _piece_rows(held: list[dict[str, np.ndarray]], salt: int, length: int) -> pa.RecordBatch:
    """One row for each group: digests and ids of texts, pieces of each, the pieces' start, number of strings, seed, bytes."""
    c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.argsort(c["bucket"], kind="stable")
    widths = c["n"] + length - 1
    heads = (np.cumsum(widths) - widths)[order]
    own = {k: c[k][order] for k in ("bucket", "sha", "ord", "start", "n", "seed")}
    widths = widths[order]
    cuts = np.flatnonzero(np.diff(own["bucket"], prepend=-1, append=-1))
    packer = zstandard.ZstdCompressor(level=1)
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        sha = own["sha"][a:b]
        first = np.flatnonzero(np.concatenate([[True], sha[1:] != sha[:-1]]))
        rows.append(
            {
                "bucket": int(own["bucket"][a]),
                "salt": salt,
                "shas": sha[first].tobytes(),
                "ords": own["ord"][a:b][first].tobytes(),
                "sizes": np.diff(np.concatenate([first, [b - a]])).astype(np.int32).tobytes(),
                "start": own["start"][a:b].astype(np.int32).tobytes(),
                "strings": own["n"][a:b].astype(np.uint8).tobytes(),
                "seed": own["seed"][a:b].tobytes(),
                "data": packer.compress(_gather(c["data"], heads[a:b], widths[a:b]).tobytes()),
            }
        )
    return pa.RecordBatch.from_pylist(rows, schema=_PIECES_ARROW)


def _gather(data: np.ndarray, start: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Substrings laid end to end."""
    out = np.empty(int(widths.sum()), data.dtype)
    at = 0
    for part in _in_parts(np.arange(len(widths)), widths):
        w = widths[part]
        to = at + int(w.sum())
        out[at:to] = data[np.arange(to - at) + np.repeat(start[part] - (np.cumsum(w) - w), w)]
        at = to
    return out


def _answered(batch: pa.RecordBatch, column: str, at: int, to: int) -> np.ndarray:
    """The seeds (their codes) that came back for some texts. A seed is as common for one text as for all others."""
    return np.frombuffer(b"".join(batch.column(column).slice(at, to - at).to_pylist()), _U)


def _shared_pieces(length: int, counted: int, compared: int):
    """Texts with the counts' answers to the pieces whose seed other texts have, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            shas, ords = _digests(batch), batch.column("ord").to_numpy()
            for at, to, data, lengths in _chunks(batch):
                text, start, n, seed = pieces(data, lengths, length)
                some = np.flatnonzero(np.isin(_code(seed, counted), _answered(batch, "shared", at, to)))
                text, start, n, seed = text[some], start[some], n[some], seed[some]
                held.append(
                    {
                        "bucket": (seed // _U(counted) % _U(compared)).astype(np.int64),
                        "sha": shas[at + text],
                        "ord": ords[at + text],
                        "start": start - (np.cumsum(lengths) - lengths)[text],
                        "n": n,
                        "seed": seed,
                        "data": _gather(data, start, n + length - 1),
                    }
                )
                size += len(data)
                if size >= SENT:
                    yield _piece_rows(held, 0, length)
                    held, size = [], 0
        if held:
            yield _piece_rows(held, 0, length)

    return run


def _common_pieces(length: int, counted: int, groups: int, salts: int):
    """Texts with the counts' answers to the pieces whose seed very many texts have, cut by longer seeds, by group and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            shas, ords = _digests(batch), batch.column("ord").to_numpy()
            for at, to, data, lengths in _chunks(batch):
                known = _answered(batch, "common", at, to)
                if not len(known):
                    continue
                text, start, n, seed = pieces(data, lengths, length)
                some = np.flatnonzero(np.isin(_code(seed, counted), known))
                start, text = start[some], text[some]
                own = _gather(data, start, n[some] + length - 1)
                piece, first, n, key = refined(own, n[some], seed[some], length, FINEST)
                text, start = text[piece], start[piece] + first
                held.append(
                    {
                        "bucket": (key % _U(groups)).astype(np.int64),
                        "sha": shas[at + text],
                        "ord": ords[at + text],
                        "start": start - (np.cumsum(lengths) - lengths)[text],
                        "n": n,
                        "seed": key,
                        "data": _gather(data, start, n + length - 1),
                    }
                )
                size += len(held[-1]["data"])
                if size >= SENT:
                    yield _piece_rows(held, _salt(held, salts), length)
                    held, size = [], 0
        if size:
            yield _piece_rows(held, _salt(held, salts), length)

    return run


def _salt(held: list[dict[str, np.ndarray]], salts: int) -> int:
    sha = next(h["sha"] for h in held if len(h["sha"]))
    return int.from_bytes(sha[0].tobytes()[:6], "big") % salts


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    """The pieces of some rows as arrays; data: their bytes end to end."""
    kinds = {"shas": f"V{DIGEST}", "ords": np.int64, "sizes": np.int32, "start": np.int32, "strings": np.uint8, "seed": _U}
    out = {c: np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in kinds.items()}
    out["n"] = out.pop("strings").astype(np.int64)
    out["text"] = np.repeat(np.arange(len(out["sizes"])), out["sizes"])
    packer = zstandard.ZstdDecompressor()
    out["data"] = np.frombuffer(b"".join(packer.decompress(x) for x in table["data"].to_pylist()), np.uint8)
    return out


def _in_parts(items: np.ndarray, widths: np.ndarray, whole: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Some items at a time, of about PART bytes; items that are next to each other and equal in `whole` stay together."""
    at = 0
    ends = np.cumsum(widths[items])
    stops = np.arange(1, len(items) + 1)
    if whole is not None and len(items):
        stops = np.flatnonzero(np.append(whole[items][1:] != whole[items][:-1], True)) + 1
    while at < len(items):
        k = int(np.searchsorted(ends[stops - 1], (ends[at - 1] if at else 0) + PART, "right"))
        to = int(stops[min(max(k - 1, int(np.searchsorted(stops, at, "right"))), len(stops) - 1)])
        yield items[at:to]
        at = to


def _hashes(data: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """A hash of each of some strings laid end to end, none of them empty."""
    out = np.zeros(len(widths), _U)
    starts = np.cumsum(widths) - widths
    powers = _powers(_BASE, int(widths.max(initial=0)))
    for part in _in_parts(np.arange(len(widths)), widths):
        own = data[starts[part[0]] : starts[part[-1]] + widths[part[-1]]]
        heads = starts[part] - starts[part[0]]
        place = np.arange(len(own)) - np.repeat(heads, widths[part])
        out[part] = np.add.reduceat((own.astype(_U) + _U(1)) * powers[place], heads)
    return _mix(out + widths.astype(_U))


def _distinct(data: np.ndarray, widths: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct piece (key and bytes) each of some pieces laid end to end is; one piece of each, by key.

    The order of distinct pieces depends on what they are, not on the order of the pieces.
    """
    starts = np.cumsum(widths) - widths
    hashes = _hashes(data, widths)
    order = np.lexsort((hashes, key))
    k, h = key[order], hashes[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])[: len(order)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    again = order[~new]
    if (widths[again] == widths[one[which[again]]]).all() and all(
        np.array_equal(_gather(data, starts[x], widths[x]), _gather(data, starts[one[which[x]]], widths[x]))
        for x in _in_parts(again, widths)
    ):
        return which, one
    # two strings with one hash
    raw = data.tobytes()
    strings = [(q, raw[a : a + w]) for q, a, w in zip(key.tolist(), starts.tolist(), widths.tolist(), strict=True)]
    found = {s: k for k, s in enumerate(sorted(set(strings)))}
    which = np.array([found[s] for s in strings], np.int64)
    return which, np.unique(which, return_index=True)[1]


def refined(data: np.ndarray, n: np.ndarray, seed: np.ndarray, length: int, levels: int) -> tuple[np.ndarray, ...]:
    """Pieces laid end to end, cut by longer seeds: piece, first string, number of strings, hash of the longer seed.

    A string's seed grows at each level by half of the bytes that the string has beside it: to the left if there are
    so many, else to the right. So equal strings have equal longer seeds, and neighbours mostly share one.
    """
    widths = n + length - 1
    starts = np.cumsum(widths) - widths
    span = length - SEED + 1
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), dtype=_U)])
    inverse = _powers(_INVERSE, len(data) + 1)
    low = _mix((sums[SEED:] - sums[:-SEED]) * inverse[: len(data) + 1 - SEED])
    # each string's first seed
    places = n + span - 1
    heads = np.cumsum(places) - places
    at = np.arange(int(places.sum())) + np.repeat(starts - heads, places)
    hit = np.where(low[at] == np.repeat(seed, places), at, len(data))
    hit = np.minimum.accumulate(hit[::-1])[::-1]
    piece = np.repeat(np.arange(len(n)), n)
    string = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[piece] + string
    lo = hit[heads[piece] + string]
    hi = lo + SEED
    for _ in range(levels):
        rest = length - (hi - lo)
        half = (rest + 1) // 2
        left = lo - begin >= half
        lo, hi = np.where(left, lo - half, lo), np.where(left, hi, hi + rest - half + 1)
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[: len(piece)]
    run = np.flatnonzero(new)
    key = _mix((sums[hi[run]] - sums[lo[run]]) * inverse[lo[run]])
    return piece[run], string[run], np.diff(np.append(run, len(piece))), key


def _strings_of(n: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places of some pieces' strings among the strings of all pieces."""
    return _gather(np.arange(int(n.sum())), (np.cumsum(n) - n)[some], n[some])


def smallest_by_string(
    data: np.ndarray, n: np.ndarray, key: np.ndarray, seed: np.ndarray, ids: np.ndarray, length: int, levels: tuple[int, ...]
) -> np.ndarray:
    """For distinct pieces in order of their keys: for all their strings in turn the smallest id of an equal string.

    Pieces are compared if they share a key. levels: of the longer seeds by which they are cut before, where their arrays are long.
    """
    widths = n + length - 1
    starts = np.cumsum(widths) - widths
    least = np.repeat(ids, n)
    if not len(n):
        return least
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pieces_of = np.diff(np.append(head, len(key)))
    symbols = np.repeat(np.add.reduceat(widths, head), pieces_of)
    several = np.repeat(pieces_of > 1, pieces_of)  # a key with one piece has nothing to compare
    cut = several & (len(levels) > 0) & ((symbols > LONG) | (len(levels) == len(LEVELS)))
    whole = np.flatnonzero(several & ~cut)
    if len(whole):
        raw = data.tobytes()
        strings = [raw[a : a + w] for a, w in zip(starts[whole].tolist(), widths[whole].tolist(), strict=True)]
        least[_strings_of(n, whole)] = np.concatenate(smallest_ids(strings, key[whole], ids[whole], length))
    for part in _in_parts(np.flatnonzero(cut), widths, key):
        own = _gather(data, starts[part], widths[part])
        piece, first, m, longer = refined(own, n[part], seed[part], length, levels[0])
        fine = _gather(own, (np.cumsum(widths[part]) - widths[part])[piece] + first, m + length - 1)
        which, one = _distinct(fine, m + length - 1, longer)
        lowest = np.full(len(one), LAST, np.int64)
        np.minimum.at(lowest, which, ids[part][piece])
        finer = _gather(fine, (np.cumsum(m + length - 1) - (m + length - 1))[one], m[one] + length - 1)
        found = smallest_by_string(finer, m[one], longer[one], seed[part][piece][one], lowest, length, levels[1:])
        least[_strings_of(n, part)] = found[_strings_of(m[one], which)]
    return least


def smallest_ids(strings: list[bytes], seeds: list[int], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For distinct pieces, ordered by seed: for each of their strings the smallest id of an equal string."""
    sizes = np.array([len(s) for s in strings], np.int64)
    seed = np.asarray(seeds, _U)
    if not len(seed):
        return []
    last = np.concatenate([seed[1:] != seed[:-1], [True]])
    if sizes.sum() > ARRAY and np.count_nonzero(last) > 1:  # some seeds at a time
        ends = np.flatnonzero(last) + 1
        half = int(ends[np.searchsorted(np.cumsum(sizes)[ends[:-1] - 1], sizes.sum() // 2).clip(0, len(ends) - 2)])
        return [
            *smallest_ids(strings[:half], seed[:half], ids[:half], length),
            *smallest_ids(strings[half:], seed[half:], ids[half:], length),
        ]
    alone = last & np.concatenate([[True], last[:-1]])
    if alone.any():  # a seed with one piece has nothing to compare
        result = [np.full(n, i, np.int64) for n, i in zip(sizes - length + 1, ids, strict=True)]
        rest = np.flatnonzero(~alone)
        if len(rest):
            for k, own in zip(rest, smallest_ids([strings[k] for k in rest], seed[rest], ids[rest], length), strict=True):
                result[k] = own
        return result
    # the pieces with a separator after each, symbol 1, or symbol 0 after the last of a seed
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = np.where(last, 0, 1)
    edges = np.concatenate([[0], ends[last] + 1])
    piece = np.repeat(np.arange(len(strings)), sizes + 1)
    first = ends - sizes
    starts_string = np.arange(len(data)) - first[piece] <= (sizes - length)[piece]
    order = np.empty(len(data), np.int64)
    lengths = np.diff(edges)
    short = np.flatnonzero(lengths <= LONG)
    short = short[np.argsort(lengths[short], kind="stable")]
    for part in np.array_split(short, max(1, int(lengths[short].sum()) // 400_000)):
        if not len(part):
            continue
        local = np.concatenate([[0], np.cumsum(lengths[part])])
        where = np.arange(local[-1]) + np.repeat(edges[part] - local[:-1], lengths[part])
        found = where[sort_many(data[where], local)]
        order[where] = found
    for s in np.flatnonzero(lengths > LONG):
        order[edges[s] : edges[s + 1]] = np.array(sort_one(data[edges[s] : edges[s + 1]].tolist())) + edges[s]
    own = order[starts_string[order]]
    # neighbours that share `length` symbols: eight bytes at a time
    packed = np.zeros(len(data) + 8, _U)
    for k in range(8):
        packed[: len(data) - k] |= (data[k:].astype(_U) & _U(255)) << _U(8 * k)
    same = piece[own[1:]] >= 0
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= packed[own[1:] + k] == packed[own[:-1] + k]
    group_of_seed = np.cumsum(np.concatenate([[0], last[:-1]]))
    same &= group_of_seed[piece[own[1:]]] == group_of_seed[piece[own[:-1]]]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(ids[piece[own]], heads)
    result = np.full(len(data), LAST, np.int64)
    result[own] = np.repeat(least, np.diff(np.concatenate([heads, [len(own)]])))
    return [result[a : a + k - length + 1] for a, k in zip(first, sizes, strict=True)]


RANGES = "sha binary, ranges binary"


def _lost(c: dict[str, np.ndarray], which: np.ndarray, n: np.ndarray, least: np.ndarray, length: int) -> pa.Table:
    """The byte ranges (lo, hi) that each text loses; n: strings of the distinct pieces, least: their smallest ids."""
    if not len(which):
        return pa.table({"sha": pa.array([], pa.binary()), "ranges": pa.array([], pa.binary())})
    least = least[_strings_of(n, which)]
    n, ord_ = c["n"], c["ords"][c["text"]]
    base = np.cumsum(n) - n
    lost = least < np.repeat(ord_, n)
    owner = np.repeat(np.arange(len(n)), n)
    # runs of lost strings within a piece
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    begins = np.flatnonzero(lost & ~(np.concatenate([[False], lost[:-1]]) & same))
    stops = np.flatnonzero(lost & ~(np.concatenate([lost[1:], [False]]) & np.concatenate([same[1:], [False]])))
    piece = owner[begins]
    lo = c["start"][piece] + begins - base[piece]
    hi = c["start"][piece] + stops - base[piece] + length
    counts = np.bincount(c["text"][piece], minlength=len(c["shas"]))
    some = np.flatnonzero(counts)
    named = pa.array([x.tobytes() for x in c["shas"][some]], pa.binary())
    return pa.table({"sha": named, "ranges": _ragged(np.column_stack([lo, hi]).astype(np.int32).ravel(), 2 * counts[some])})


def _laid_down(c: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which distinct piece each piece is; the distinct pieces: seeds (in order), strings, smallest ids, bytes."""
    widths = c["n"] + length - 1
    which, one = _distinct(c["data"], widths, c["seed"])
    ids = np.full(len(one), LAST, np.int64)
    np.minimum.at(ids, which, c["ords"][c["text"]])
    data = _gather(c["data"], (np.cumsum(widths) - widths)[one], widths[one])
    return which, {"seed": c["seed"][one], "n": c["n"][one], "ids": ids, "data": data}


def _lost_ranges(length: int):
    """Per group of pieces: the byte ranges that are lost, by text."""

    def run(group: pa.Table) -> pa.Table:
        c = _columns(group)
        which, one = _laid_down(c, length)
        least = smallest_by_string(one["data"], one["n"], one["seed"], one["seed"], one["ids"], length, LEVELS)
        return _lost(c, which, one["n"], least, length)

    return run


COMBINED = "bucket int, salt int, fine int, ords binary, strings binary, seed binary, data binary"


def _fine(seed: np.ndarray, groups: int, salts: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a salted group by the group in which they are compared: their order, groups."""
    fine = (seed // _U(groups) % _U(salts)).astype(np.int64)
    order = np.argsort(fine, kind="stable")
    return order, fine[order]


def _combine(length: int, groups: int, salts: int):
    """Per salted group of common seeds' pieces: equal pieces once, with their smallest id, by the group that compares them."""

    def run(group: pa.Table) -> pa.Table:
        _, one = _laid_down(_columns(group), length)
        order, fine = _fine(one["seed"], groups, salts)
        widths = one["n"] + length - 1
        starts = (np.cumsum(widths) - widths)[order]
        own = {"ords": one["ids"][order], "strings": one["n"][order].astype(np.uint8), "seed": one["seed"][order]}
        cuts = np.flatnonzero(np.diff(fine, prepend=-1, append=-1))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        packer = zstandard.ZstdCompressor(level=1)
        out = {k: [x[a:b].tobytes() for a, b in spans] for k, x in own.items()}
        out["data"] = [packer.compress(_gather(one["data"], starts[a:b], widths[order[a:b]]).tobytes()) for a, b in spans]
        same = {k: pa.array([group[k][0].as_py()] * len(spans), pa.int32()) for k in ("bucket", "salt")}
        return pa.table({**same, "fine": pa.array(fine[cuts[:-1]], pa.int32()), **{k: pa.array(x, pa.binary()) for k, x in out.items()}})

    return run


def _smallest_of_common(length: int):
    """Per group, over its salted groups: the smallest ids of their pieces' strings, in their order."""

    def run(group: pa.Table) -> pa.Table:
        kinds = {"ords": np.int64, "strings": np.uint8, "seed": _U}
        c = {k: np.frombuffer(b"".join(group[k].to_pylist()), kind) for k, kind in kinds.items()}
        c["n"], c["text"] = c["strings"].astype(np.int64), np.arange(len(c["ords"]))
        unpacker = zstandard.ZstdDecompressor()
        c["data"] = np.frombuffer(b"".join(unpacker.decompress(x) for x in group["data"].to_pylist()), np.uint8)
        which, one = _laid_down(c, length)
        least = smallest_by_string(one["data"], one["n"], one["seed"], one["seed"], one["ids"], length, ())
        found = least[_strings_of(one["n"], which)]
        cuts = np.concatenate([[0], np.cumsum(c["n"])])[np.cumsum([0, *[len(x) for x in group["strings"].to_pylist()]])]
        cells = [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"bucket": group["bucket"], "salt": group["salt"], "fine": group["fine"], "least": pa.array(cells, pa.binary())})

    return run


def _lost_common(length: int, groups: int, salts: int):
    """Per salted group and its smallest ids: the byte ranges that are lost, by text."""

    def run(pieces_: pa.Table, least: pa.Table) -> pa.Table:
        c = _columns(pieces_)
        which, one = _laid_down(c, length)
        order, _ = _fine(one["seed"], groups, salts)
        found = np.frombuffer(b"".join(least.sort_by("fine")["least"].to_pylist()), np.int64)
        by_piece = np.empty(len(found), np.int64)
        by_piece[_strings_of(one["n"], order)] = found
        return _lost(c, which, one["n"], by_piece, length)

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ord (id, LAST for none), raw (UTF-8)."""
    ord_ = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return docs.select(ord_.alias("ord"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def _heads(texts: DataFrame) -> DataFrame:
    """Distinct texts: sha, ord (the smallest), raw."""
    # max: all are equal
    return texts.groupBy(_digest(F.col("raw")).alias("sha")).agg(F.min("ord").alias("ord"), F.max("raw").alias("raw"))


def _digest(raw: Column) -> Column:
    """The text's name. It is never null, and says so: else joins would filter nulls below an exchange, which then differs from the others."""
    return F.coalesce(F.substring(F.unhex(F.sha2(raw, 256)), 1, DIGEST), F.lit(b""))


def _answers(heads: DataFrame, length: int, counted: int, frequent: np.ndarray) -> DataFrame:
    """One row for each distinct text with seeds that other texts have: sha, shared, common.

    A batch of texts must be the same if a task is run again, so its texts are in order.
    """
    known = heads.sparkSession.sparkContext.broadcast(frequent)
    keys = heads.sortWithinPartitions("sha").mapInArrow(_count_rows(length, counted, known), KEYS)
    counts = keys.groupBy("bucket").applyInArrow(_count(COMMON), COUNTS)
    return counts.groupBy("batch").applyInArrow(_by_text, ANSWERS)


def salted(rows: int, compared: int) -> tuple[int, int]:
    """Groups and salts of common seeds' pieces. Their product follows the bytes of text, not its square."""
    salts = 1 + rows // SALTED
    return max(1, compared // salts), salts


def per_text(
    docs: DataFrame, length: int, id_col: str, text_col: str, fn: Callable[[bytes, np.ndarray], dict], schema: str
) -> DataFrame:
    """sha, ord and what fn makes of each distinct text's bytes and lost ranges (an array of edges, lo and hi in turn)."""
    if length < SEED + 4:
        raise ValueError(f"strings of fewer than {SEED + 4} bytes have no seeds")
    texts = _texts(docs, id_col, text_col)
    rows, total = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()
    counted, compared = (1 + total // x for x in (COUNTED, COMPARED))
    groups, salts = salted(rows, compared)
    frequent = _frequent_seeds(texts, rows, total, length, counted)
    heads = _heads(texts)
    answers = _answers(heads, length, counted, frequent)
    both = heads.join(answers, "sha")
    shared = both.mapInArrow(_shared_pieces(length, counted, compared), PIECES)
    lost = shared.groupBy("bucket").applyInArrow(_lost_ranges(length), RANGES)
    # on both sides of the join, so that the filter stays above it and the exchanges below are those of `shared`
    with_common = both.where((F.octet_length("common") > 0) | F.col("raw").isNull())
    strings = with_common.mapInArrow(_common_pieces(length, counted, groups, salts), PIECES)
    dealt = strings.groupBy("bucket", "salt")
    combined = dealt.applyInArrow(_combine(length, groups, salts), COMBINED)
    least = combined.groupBy("bucket", "fine").applyInArrow(_smallest_of_common(length), "bucket int, salt int, fine int, least binary")
    lost_common = dealt.cogroup(least.groupBy("bucket", "salt")).applyInArrow(_lost_common(length, groups, salts), RANGES)
    ranges = lost.unionByName(lost_common).groupBy("sha").agg(F.collect_list("ranges").alias("ranges"))
    fields = StructType.fromDDL("sha binary, ord long, " + schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [
                    fn(raw, merged(np.frombuffer(b"".join(r or ()), np.int32)))
                    for raw, r in zip(part.column("raw").to_pylist(), part.column("ranges").to_pylist(), strict=True)
                ]
                made = [pa.array([r[f.name] for r in rows], type=f.type) for f in list(arrow)[2:]]
                yield pa.RecordBatch.from_arrays([part.column("sha"), part.column("ord"), *made], schema=arrow)

    return heads.join(ranges, "sha", "left").mapInArrow(run, fields)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (lo, hi, lo, hi ...) in order, joined where they touch."""
    lo, hi = ranges[::2], ranges[1::2]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return np.column_stack([lo[first], hi[np.append(first[1:], len(lo)) - 1]]).ravel() if len(lo) else lo


def cut_out(raw: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return raw
    edges = [0, *spans.tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _known(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs with _sha, _ord, _n (bytes of the text); the text itself is left behind."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        *[F.col(c) for c in docs.columns if c != text_col],
        _digest(raw).alias("_sha"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_ord"),
        F.octet_length(raw).cast("long").alias("_n"),
        F.when(F.octet_length(raw) < length, F.col(text_col)).alias("_short"),
        F.col(text_col).isNull().alias("_none"),
    )


def repeat_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, for each row."""

    def digest(raw: bytes, spans: np.ndarray) -> dict:
        lost = int((spans[1::2] - spans[::2]).sum())
        return {"lost": lost, "spans": len(spans) // 2, "kept": hashlib.sha256(cut_out(raw, spans)).hexdigest()}

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = per_text(slim, length, "doc_id", "text", digest, "lost long, spans long, kept string")
    copy = (F.col("_ord") > F.col("ord")) & (F.col("_n") >= length)
    return (
        _known(slim, length, "doc_id", "text")
        .join(found, F.col("_sha") == F.col("sha"))
        .select(
            "doc_id",
            F.col("_n").alias("n_bytes"),
            F.when(copy, F.col("_n")).otherwise(F.col("lost")).alias("n_removed"),
            F.when(copy, F.lit(1).cast("long")).otherwise(F.col("spans")).alias("n_spans"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept")).alias("kept_sha256"),
        )
    )


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their remaining text; characters that lose a part of their bytes go with them."""

    def rest(raw: bytes, spans: np.ndarray) -> dict:
        return {"kept": cut_out(raw, spans).decode("utf-8", "ignore") if len(raw) >= length else None}

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = per_text(slim, length, "_id", "_text", rest, "kept string").select(
        F.col("sha").alias("_key"), F.col("ord").alias("_least"), F.col("kept").alias("_kept")
    )
    text = (
        F.when(F.col("_none"), F.lit(None))
        .when(F.col("_n") < length, F.col("_short"))
        .when(F.col("_ord") > F.col("_least"), F.lit(""))
        .otherwise(F.col("_kept"))
    )
    joined = _known(docs, length, id_col, text_col).join(found, F.col("_sha") == F.col("_key"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
