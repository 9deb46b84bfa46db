"""Best-fit packing of documents into sequences by bin completion.

Lengths are whole numbers up to the capacity, so all pieces together are a histogram with at most
`capacity` entries, however many documents there are. The search works on that histogram: it
takes the largest piece that is left, enumerates the undominated fillings of the room beside it,
and applies one as often as the counts allow. Taking the best fit each time gives the first
solution. Branch and bound then tries the other fillings, and leaves a branch as soon as its
waste exceeds what a solution with one sequence fewer could afford. It ends when the number of
sequences equals the lower bound or when its limits, `breadth` fillings a node and `nodes`, are
spent. While the lower bound isn't met, the search starts anew with more fillings a node (WIDTHS), and the
best solution of all counts. Without limits (None) it enumerates every undominated filling, decides on
one sequence at a time and never gives up a branch that could improve, so the result is optimal; that is
for small histograms. `packing_report` says how far a solution is from the lower bound.

The solution is a list of slots: ranks a..b of length s go to sequences c.. at offset d. Pieces
get their rank within their length from counts by hash group, so no length, however common, is
ordered in one task, and each piece finds its slot by its rank. The list has a size that depends
on the capacity and not on the documents.

Cases: a null text is empty and makes one piece with the end id; ids may be null or repeat; very
long texts are cut into pieces of the capacity, the last one shorter; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, map_columns, vocabulary

END = (0).to_bytes(4, "little")
CACHE_ENTRIES = 500_000  #: words that a worker keeps the ids of (about 100 bytes each)
KEPT_ENTRIES = 100_000  #: words and parts that it keeps from one partition to the next
WIDTHS = ((6, 100), (40, 500), (160, 50))  #: fillings a node and nodes, one search after the other until the lower bound is met
GROUP_ROWS = 20_000  #: pieces that share a hash group when ranks are dealt

# Words of Latin letters with ASCII punctuation after them; all others go through the whole tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# Blanks for Python that aren't blanks for the tokenizer, and text that may hold a special token.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers print each byte as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Ids (as little-endian bytes) of words between blanks, made when first asked for.

    The tokenizer never joins what blanks separate, so a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def part(self, piece: str) -> bytes:
        """Ids of one run of letters or of punctuation, in lower case."""
        ids = self.parts.get(piece)
        if ids is None:
            # printable ASCII is spelt as it is
            spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.bytes[t.id] for t in self.model.tokenize(spelt)])
            if len(self.parts) >= CACHE_ENTRIES:
                self.parts.clear()
            self.parts[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if m:
            ids = self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in _ODD):
            return self.whole(text)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        return b"".join([self[w] for w in text.split()])


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(vocabulary(path))


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenize; one row a piece of at most `capacity` ids, the document's last id being the end id."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        ids_of = word_ids(tokenizer_path).encode
        out: dict[str, list] = {c.split()[0]: [] for c in PIECE_SCHEMA.split(", ")}
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            ids = ids_of(text or "") + END
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
        return out

    def done() -> None:
        """A worker lives on after its partition; it then keeps a small cache only."""
        held = word_ids(tokenizer_path)
        if len(held) + len(held.parts) > KEPT_ENTRIES:
            held.clear()
            held.parts.clear()

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(named, run, PIECE_SCHEMA, 500, done)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces that can't share one."""
    best = math.ceil(sum(s * n for s, n in counts.items()) / capacity)
    sizes = sorted(counts)
    for k in [s for s in sizes if s <= capacity // 2] or [1]:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, math.ceil((small - room) / capacity)))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b can be grouped into the pieces of a (so a is never the worse filling)."""

    def place(rest: tuple[int, ...], room: tuple[int, ...]) -> bool:
        if not rest:
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= rest[0] and r not in tried:
                tried.add(r)
                if place(rest[1:], (*room[:i], r - rest[0], *room[i + 1 :])):
                    return True
        return False

    return sum(a) >= sum(b) and place(b, a)


def all_completions(room: int, counts: dict[int, int]) -> list[tuple[int, ...]]:
    """Every undominated filling of the room by pieces that are left, best fit first."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    full: list[tuple[int, ...]] = []

    def fill(k: int, rest: int, taken: tuple[int, ...]) -> None:
        if k == len(sizes):
            # maximal: no piece that is left fits
            if not any(s <= rest and counts[s] > taken.count(s) for s in sizes):
                full.append(taken)
            return
        s = sizes[k]
        for n in range(min(counts[s], rest // s), -1, -1):
            fill(k + 1, rest - n * s, taken + (s,) * n)

    fill(0, room, ())
    full.sort(key=lambda f: (-sum(f), len(f), [-s for s in f]))
    kept: list[tuple[int, ...]] = []
    for f in full:
        if not any(_dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def completions(room: int, counts: dict[int, int], most: int | None) -> list[tuple[int, ...]]:
    """Undominated fillings of the room by pieces that are left, best fit first, at most `most` (None: all)."""
    if most is None:
        return all_completions(room, counts)
    sizes = np.array(sorted(s for s, n in counts.items() if n and s <= room), dtype=np.int64)
    if not len(sizes):
        return [()]
    first = int(sizes[-1])
    found = {(first,)}

    def pairs(rest: int, keep: int) -> list[tuple[int, int]]:
        own = sizes[: int(np.searchsorted(sizes, rest, "right"))]
        at = np.searchsorted(own, np.minimum(rest - own, own), "right") - 1
        ok = at >= 0
        a, b = own[ok], own[at[ok]]
        order = np.lexsort((-a, -(a + b)))[:keep]
        return [(int(x), int(y)) for x, y in zip(a[order], b[order], strict=True) if x != y or counts[int(x)] > 1]

    if first < room:
        found |= set(pairs(room, most))
        if not any(sum(f) == room for f in found):
            for a in sizes[::-1][:most]:
                for b, c in pairs(room - int(a), 2):
                    if b <= a and all(counts[x] >= (a, b, c).count(x) for x in (b, c)):
                        found.add((int(a), b, c))

    def grown(filling: tuple[int, ...]) -> tuple[int, ...]:
        """The filling with the largest pieces that still fit, until none does."""
        rest, used, out = room - sum(filling), {}, list(filling)
        for s in filling:
            used[s] = used.get(s, 0) + 1
        at = bisect_right(sizes, rest) - 1
        while at >= 0 and rest > 0:
            s = int(sizes[at])
            n = min(rest // s, counts[s] - used.get(s, 0))
            out += [s] * n
            rest -= s * n
            at = min(at - 1, bisect_right(sizes, rest) - 1)
        return tuple(sorted(out, reverse=True))

    full = sorted({grown(f) for f in found}, key=lambda f: (-sum(f), len(f), [-s for s in f]))[: 2 * most]
    kept: list[tuple[int, ...]] = []
    for f in full:
        if len(f) > 6 or not any(len(k) <= 6 and _dominates(k, f) for k in kept):
            kept.append(f)
    return kept[:most]


def pack_histogram(
    counts: dict[int, int], capacity: int, breadth: int | None = 6, nodes: int | None = 2000
) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, largest first) with the number of sequences that get each. None: no limit."""
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity) if counts else 0
    exact = breadth is None and nodes is None
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_n = 0

    def step(left: dict[int, int], filling: tuple[int, ...], times: int | None = None) -> int:
        if times is None:
            times = 1 if exact else min(left[s] // filling.count(s) for s in set(filling))
        for s in filling:
            left[s] -= times
        for s in set(filling):
            if not left[s]:
                del left[s]
        return times

    def dive(left: dict[int, int], done: list[tuple[tuple[int, ...], int]], waste: int) -> list[list]:
        """Take the best fit at every node; returns the nodes on the way: their depth in done, waste and other fillings."""
        nonlocal best, best_n
        path = []
        used = sum(n for _, n in done)
        while left:
            if best is not None and waste > (best_n - 1) * capacity - total:
                return path
            largest = max(left)
            beside = dict(left)
            beside[largest] -= 1
            options = [(largest, *c) for c in completions(capacity - largest, beside, breadth)]
            if len(options) > 1:
                path.append([done, len(done), waste, options[1:]])
            times = step(left, options[0])
            done.append((options[0], times))
            used += times
            waste += times * (capacity - sum(options[0]))
        if best is None or used < best_n:
            best, best_n = list(done), used
        return path

    stack = dive(dict(counts), [], 0)
    spent = 0
    while stack and best_n > bound and (nodes is None or spent < nodes):
        done, depth, waste, options = stack[-1]
        if not options or waste > (best_n - 1) * capacity - total:
            stack.pop()
            continue
        option = options.pop(0)
        left, done = dict(counts), done[:depth]
        for filling, times in done:
            step(left, filling, times)
        times = step(left, option)
        done.append((option, times))
        more = dive(left, done, waste + times * (capacity - sum(option)))
        spent += 1 + len(more)
        stack += more
    return best or []


def search(
    counts: dict[int, int], capacity: int, widths: tuple[tuple[int | None, int | None], ...] = WIDTHS
) -> list[tuple[tuple[int, ...], int]]:
    """The best solution of searches that get wider until one meets the lower bound."""
    best: list[tuple[tuple[int, ...], int]] = []
    for breadth, nodes in widths if counts else ():
        found = pack_histogram(counts, capacity, breadth, nodes)
        if not best or packing_report(counts, found, capacity)["sequences"] < packing_report(counts, best, capacity)["sequences"]:
            best = found
        report = packing_report(counts, best, capacity)
        if report["sequences"] == report["lower_bound"]:
            break
    return best


def packing_report(counts: dict[int, int], solution: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, int]:
    """Sequences of a solution and the fewest that any packing needs by the lower bound."""
    return {"sequences": sum(n for _, n in solution), "lower_bound": lower_bound(counts, capacity) if counts else 0}


def slots_of(solution: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of this length a sequence, offset), by rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for filling, times in solution:
        offset = 0
        for s in sorted(set(filling), reverse=True):
            n = filling.count(s)
            rows.setdefault(s, []).append((ranks.get(s, 0), sequence, n, offset))
            ranks[s] = ranks.get(s, 0) + times * n
            offset += s * n
        sequence += times
    return {s: np.array(r, dtype=np.int64) for s, r in rows.items()}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    widths: tuple[tuple[int | None, int | None], ...] = WIDTHS,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    widths: fillings a node and nodes of the searches, ((None, None),) for an exhaustive one.
    """
    pieces = cut(
        cut_pieces(docs, tokenizer_path, capacity, id_col, text_col).withColumn(
            "row", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
        )
    )
    by_length = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_length.collect()}  # at most `capacity` rows
    slots = slots_of(search(counts, capacity, widths))

    groups = 1 + sum(counts.values()) // GROUP_ROWS
    grouped = pieces.withColumn("g", F.pmod("row", F.lit(groups)))
    below = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        grouped.groupBy("length", "g")
        .agg(F.count("*").alias("n"))
        .select("length", "g", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "row")
    ranked = (
        grouped.withColumn("k", F.row_number().over(within))
        .join(bases, ["length", "g"])
        .select(*PIECE_COLUMNS, (F.col("base") + F.col("k") - 1).alias("rank"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # its size depends on the capacity alone

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                rows = order[a:b]
                table = shared.value[int(length[rows[0]])]
                at = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                first, seq, n, off = table[at].T
                k = rank[rows] - first
                sequence[rows] = seq + k // n
                offset[rows] = off + k % n * length[rows]
            kept = [batch.column(c) for c in PIECE_COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*PIECE_COLUMNS, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")


PIECE_COLUMNS = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
