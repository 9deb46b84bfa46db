"""MinHash near-dedup with ProbMinHash signatures.

A document is its multiset of five-word shingles. Each shingle sends a Poisson process of arrivals,
at a rate that is its count, to the components of the signature; a component keeps the shingle
that arrives first, and a shingle stops as soon as its next arrival comes later than every
component's first. Two documents agree in a component with their probability Jaccard similarity,
which is the plain Jaccard similarity where no shingle repeats. A text whose shingles repeat has a
second signature, with every count 1, for its plain similarity; for other texts the two are one.

A link needs a probability Jaccard or a plain Jaccard similarity of `similarity` or more, each of
which has its own signature from the sketch to the exact check.

Texts that have the same words are one vertex. Vertices that agree in a band of components, of
either signature, meet in a bucket. A bucket's members are first paired with its smallest member (a
star, not all pairs); pairs whose signatures promise a link are checked exactly, and links are
joined into classes. A bucket may still hold several classes. Then its members outside its largest
class meet all its members in blocks of bounded size, at first with their signatures alone. Texts
are fetched only for members that a signature of another class promises a link with, in that
block, and compared unless links of the block have joined them already. Copies in one class are
never paired with each other.

What is lost: a pair of similarity 0.8 shares no band once in 40,000 times, and fails the screen of
signatures (PROMISING) once in 100,000; the tests measure both. Nothing is lost beyond these.

Cases: a text of one to four words is one shingle; texts without words are alike only if the same
(null is empty); rows without an id get no class and match nothing; rows that share an id are one
document; an empty table gives an empty result; other columns are ignored by `near_classes`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, map_columns

WORDS = 5
BANDS, ROWS = 20, 4
COMPONENTS = BANDS * ROWS
BLOCK = 1024  #: members of a bucket that are compared with as many others at once
TOGETHER = 4096  #: members of small buckets, about, that share a group
FILTER_WORDS = 1 << 17  #: 64-bit words of the filter that keeps texts that nothing needs from moving
PROMISING = 0.6  #: the part of a signature that pairs of similarity 0.8 fail to share once in 10**5

_U = np.uint64
_WORD_BYTES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def normal(text: str | None) -> bytes:
    """The words in lower case with single blanks."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


def _word_hashes(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the blank-separated words of some bytes (one blank at the end)."""
    ends = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    base = _U(0x9E3779B97F4A7C15)
    powers = np.full(int((ends - starts).max()) + 2, base)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(line)) - np.repeat(starts, ends - starts + 1)
    terms = (line.astype(_U) + _U(1)) * powers[place]
    return _mix(np.add.reduceat(terms, starts)), starts


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of some normal texts: row, hash, count, by row and hash."""
    rows = [i for i, x in enumerate(lines) if x]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    data = np.frombuffer(b" ".join([lines[i] for i in rows]) + b" ", np.uint8)
    words, starts = _word_hashes(data)
    edges = np.cumsum([0, *[len(lines[i]) + 1 for i in rows]])
    first = np.searchsorted(starts, edges)
    n_words = np.diff(first)
    n = np.maximum(1, n_words - WORDS + 1)
    row = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    end = first[1:][row]
    mixed = np.zeros(len(row), _U)
    for k in range(WORDS):
        there = at + k < end
        word = np.where(there, words[np.minimum(at + k, len(words) - 1)], _U(0))
        mixed = _mix(mixed * _U(31) + word + _U(k + 1))
    order = np.lexsort((mixed, row))
    row, mixed = row[order], mixed[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1])]))
    counts = np.diff(np.concatenate([new, [len(row)]])).astype(np.float64)
    return np.asarray(rows)[row[new]], mixed[new], counts


def signatures(n_rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ProbMinHash: for each row the shingles that arrive first in each component."""
    first = np.full(n_rows * COMPONENTS, np.inf)
    who = np.zeros(n_rows * COMPONENTS, _U)
    time = np.zeros(len(row))
    step = 0
    while len(row):
        bits = _mix(shingle + _U((step * 0xD1342543DE82EF95 + 1) % (1 << 64)))
        time = time - np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        if step:  # later than the last of the row's components to be filled: this shingle is done
            go = time < first.reshape(-1, COMPONENTS).max(1)[row]
            row, shingle, weight, time, bits = row[go], shingle[go], weight[go], time[go], bits[go]
        at = row * COMPONENTS + (_mix(bits) % _U(COMPONENTS)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = shingle[won]
        step += 1
    return who.reshape(-1, COMPONENTS)


def _buckets(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature (components are the last axis)."""
    folded = np.zeros((*sig.shape[:-1], BANDS), _U) + np.arange(BANDS, dtype=_U)
    for k in range(ROWS):
        folded = _mix(folded * _U(31) + sig[..., k::ROWS].astype(_U) + _U(1))
    return folded.view(np.int64)


def _both(sigs: list[bytes]) -> np.ndarray:
    """Rows x 2 x components: the signature of the counts and the plain one, which are one where no shingle repeats."""
    whole = 2 * COMPONENTS * np.dtype(np.uint16).itemsize
    return np.frombuffer(b"".join(s if len(s) == whole else s * 2 for s in sigs), np.uint16).reshape(-1, 2, COMPONENTS)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (equal for equal words) and sig, of 16 bits a component; empty for texts without words.

    sig holds the signature of the counts and, where a shingle repeats, that of the plain set behind it.
    """

    def run(columns: dict[str, list]) -> dict[str, list]:
        texts = columns["text"]
        lines = [normal(t) for t in texts]
        keys = [
            hashlib.md5(b"words" + x if x else b"none" + (t or "").encode("utf-8", "surrogatepass")).digest()
            for x, t in zip(lines, texts, strict=True)
        ]
        row, shingle, count = shingles(lines)
        twice = np.zeros(len(lines), bool)  # has a shingle that repeats
        twice[row[count > 1]] = True
        sig = signatures(len(lines), row, shingle, count).astype(np.uint16)
        plain = signatures(len(lines), row[twice[row]], shingle[twice[row]], np.ones(int(twice[row].sum()))).astype(np.uint16)
        held = [c.tobytes() + (p.tobytes() if t else b"") for c, p, t in zip(sig, plain, twice, strict=True)]
        return {"doc_id": columns["doc_id"], "key": keys, "sig": [h if x else b"" for h, x in zip(held, lines, strict=True)]}

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(named.where("doc_id is not null"), run, "doc_id long, key binary, sig binary", 500)


def _held(heads: DataFrame) -> DataFrame:
    """Vertices (v, sig) to the buckets they lie in: v, bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("v").to_numpy()
            buckets = np.sort(_buckets(_both(batch.column("sig").to_pylist())).reshape(len(ids), -1), axis=1)
            fresh = np.concatenate([np.ones((len(ids), 1), bool), buckets[:, 1:] != buckets[:, :-1]], axis=1)
            v = np.repeat(ids, fresh.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(buckets[fresh])], names=["v", "bucket"])

    return heads.where(F.octet_length("sig") > 0).select("v", "sig").mapInArrow(run, "v long, bucket long")


def _needed_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """v, text of the documents (v, text) that are in needed (v).

    Most documents are stopped before the exchange by a filter of fixed size, one bit for each
    value of a hash, that has the bits of those that are needed; it lets through more than needed.
    """
    word = F.pmod(F.xxhash64("v", F.lit("word")), F.lit(FILTER_WORDS))
    place = F.pmod(F.xxhash64("v", F.lit("bit")), F.lit(64)).cast("int")
    bits = needed.select(word.alias("word"), place.alias("place")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")
    )
    likely = docs.withColumn("at", word).join(F.broadcast(bits), F.col("at") == F.col("word"))
    likely = likely.where(F.getbit("bits", place) == 1).select("v", "text")
    return likely.join(needed, "v", "left_semi").distinct()


def probability_jaccard(a: dict, b: dict) -> float:
    """Of two shingle counts (arrays `h`, sorted, and `n`): the sum over common x of 1 / sum over y of max(a_y / a_x, b_y / b_x)."""
    both, ia, ib = np.intersect1d(a["h"], b["h"], assume_unique=True, return_indices=True)
    x = np.concatenate([a["n"][ia], np.delete(a["n"], ia), np.zeros(len(b["h"]) - len(both))])
    y = np.concatenate([b["n"][ib], np.zeros(len(a["h"]) - len(both)), np.delete(b["n"], ib)])
    pairs, times = np.unique(np.column_stack([x, y])[: len(both)], axis=0, return_counts=True)
    return float(sum(t / np.maximum(x / px, y / py).sum() for (px, py), t in zip(pairs, times, strict=True)))


def similarity_of(a: dict, b: dict) -> float:
    """The larger of the probability Jaccard and the plain Jaccard similarity of two shingle counts."""
    if not len(a["h"]) or not len(b["h"]):
        return 0.0
    common = len(np.intersect1d(a["h"], b["h"], assume_unique=True))
    plain = common / (len(a["h"]) + len(b["h"]) - common)
    if not common or max(a["n"].max(), b["n"].max()) == 1:
        return plain
    return max(plain, probability_jaccard(a, b))


def _counts_of(texts: list[str]) -> list[dict]:
    row, h, n = shingles([normal(t) for t in texts])
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    return [{"h": h[s:e], "n": n[s:e]} for s, e in zip(edges, edges[1:], strict=False)]


def _verify(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are links; sigs: v, sig; docs: v, text."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_both(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
            keep = pa.array((x == y).mean(2).max(1) >= PROMISING, pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    promising = (
        pairs.join(sigs.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(alike, "a long, b long")
    )
    promising = cut(promising.distinct())

    def linked(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        half = len(columns["a"])
        sets = _counts_of([*columns["text_a"], *columns["text_b"]])
        for a, b, x, y in zip(columns["a"], columns["b"], sets[:half], sets[half:], strict=True):
            if similarity_of(x, y) >= similarity - 1e-12:
                out["a"].append(a)
                out["b"].append(b)
        return out

    slim = cut(_needed_texts(docs, promising.select(F.explode(F.array("a", "b")).alias("v")).distinct()))
    texts_a = slim.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
    texts_b = slim.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    with_texts = promising.join(texts_a, "a").join(texts_b, "b").select("a", "b", "text_a", "text_b")
    return map_columns(with_texts, linked, "a long, b long", 100)


def components(edges: DataFrame) -> DataFrame:
    """v and comp, the smallest vertex that links lead to, for every vertex of the edges (a, b)."""
    both = cut(
        edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
        .unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        .distinct()
    )
    labels = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("comp").alias("c")), "w")
        best = near.groupBy("v").agg(F.min("c").alias("c"))
        stepped = labels.join(best, "v").select("v", "comp", F.least("comp", "c").alias("to"))
        # and on to where that vertex points
        jump = labels.select(F.col("v").alias("to"), F.col("comp").alias("far"))
        moved = cut(stepped.join(jump, "to", "left").select("v", "comp", F.least("to", "far").alias("new")))
        labels = moved.select("v", F.col("new").alias("comp"))
        if moved.where("new != comp").isEmpty():
            return labels


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets with several classes, dealt to blocks: bucket, i, j, small, v, comp, outside, guest.

    members: bucket, n, v, comp. The residents of block (i, j) are part i of a bucket's members, its guests
    are part j of those outside the bucket's largest class. small: the bucket is one block.
    """
    classes = members.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    most = classes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.max("size").alias("most"))
    held = members.join(cut(most), "bucket")
    held = held.withColumn("outside", F.col("comp") != F.col("largest"))
    parts, guest_parts = (F.ceil(c / BLOCK).cast("int") for c in (F.col("n"), F.col("n") - F.col("most")))
    held = held.withColumn("parts", parts).withColumn("guest_parts", F.greatest(F.lit(1), guest_parts))
    own = "cast(pmod(xxhash64(v, '{0}'), {0}) AS int)"
    every = F.explode(F.sequence(F.lit(0), F.col("to") - 1))
    residents = held.withColumn("i", F.expr(own.format("parts"))).withColumn("to", F.col("guest_parts")).withColumn("j", every)
    guests = held.where("outside").withColumn("j", F.expr(own.format("guest_parts"))).withColumn("to", F.col("parts")).withColumn("i", every)
    small = (F.col("parts") == 1) & (F.col("guest_parts") == 1)
    columns = ["bucket", "i", "j", small.alias("small"), "v", "comp", "outside"]
    return residents.select(*columns, F.lit(False).alias("guest")).unionByName(guests.select(*columns, F.lit(True).alias("guest")))


class _Pairs:
    """Residents r and guests g of a block, and which pairs of other classes a signature promises a link.

    A pair belongs to the first bucket that its two members have in common, and there to one block.
    """

    def __init__(self, bucket: int, r: pd.DataFrame, g: pd.DataFrame):
        self.bucket, self.ids_r, self.ids_g = bucket, r["v"].to_numpy(), g["v"].to_numpy()
        self.comp_r, self.comp_g = r["comp"].to_numpy().copy(), g["comp"].to_numpy().copy()
        self.outside = r["outside"].to_numpy()
        self.sig_r, self.sig_g = _both(list(r["sig"])), _both(list(g["sig"]))
        self.buckets_r, self.buckets_g = _buckets(self.sig_r), _buckets(self.sig_g)

    def promised(self, k: int) -> np.ndarray:
        """Residents that guest k may be linked with, the likeliest first."""
        alike = np.count_nonzero(self.sig_r == self.sig_g[k], axis=2).max(1)
        # two members outside the largest class meet twice, as guest and resident and the other way round
        twice = self.outside & (self.ids_r < self.ids_g[k])
        at = np.flatnonzero((alike >= PROMISING * COMPONENTS) & (self.comp_r != self.comp_g[k]) & ~twice)
        return at[np.argsort(-alike[at], kind="stable")]

    def here(self, k: int, at: np.ndarray) -> np.ndarray:
        """Those of them whose pairs with guest k belong to this bucket."""
        own = self.buckets_r[at]
        shared = (own[:, :, None, :] == self.buckets_g[k][None, None]).any(2)
        return at[np.where(shared, own, np.iinfo(np.int64).max).min((1, 2)) == self.bucket]

    def needed(self) -> tuple[np.ndarray, np.ndarray]:
        """Residents and guests that are in a promised pair of this bucket."""
        hit_r, hit_g = np.zeros(len(self.ids_r), bool), np.zeros(len(self.ids_g), bool)
        for k in range(len(self.ids_g)):
            at = self.promised(k)
            fresh = self.here(k, at[~hit_r[at]])
            hit_r[fresh] = True
            hit_g[k] = bool(len(fresh)) or bool(len(self.here(k, at)))
        return np.flatnonzero(hit_r), np.flatnonzero(hit_g)

    def links(self, sets_r: list[dict], sets_g: list[dict], similarity: float) -> list[tuple[int, int]]:
        """Links of promised pairs that the links before have not joined."""
        found = []
        _, number = np.unique(np.concatenate([c["h"] for c in (*sets_r, *sets_g)]), return_inverse=True)
        sizes = np.array([len(c["h"]) for c in (*sets_r, *sets_g)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        repeats = np.array([c["n"].max(initial=1) > 1 for c in (*sets_r, *sets_g)])
        n = len(sets_r)
        own = np.zeros(len(number) + 1, np.int64)  # by number: whether the guest has the shingle
        for k in range(len(self.ids_g)):
            at = self.here(k, self.promised(k))
            if not len(at):
                continue
            mine = number[edges[n + k] : edges[n + k + 1]]
            own[mine] = 1
            shared = np.concatenate([[0], np.cumsum(own[number[: edges[n]]])])
            own[mine] = 0
            common = (shared[edges[1 : n + 1]] - shared[edges[:n]])[at]
            plain = common / (sizes[at] + len(mine) - common)
            for m, alike in zip(at, plain, strict=True):
                if self.comp_r[m] == self.comp_g[k]:
                    continue
                if alike < similarity - 1e-12 and (repeats[m] or repeats[n + k]):
                    alike = probability_jaccard(sets_g[k], sets_r[m])
                if alike >= similarity - 1e-12:
                    found.append((int(self.ids_g[k]), int(self.ids_r[m])))
                    old, new = self.comp_r[m], self.comp_g[k]
                    self.comp_r[self.comp_r == old] = new
                    self.comp_g[self.comp_g == old] = new
        return found


def _cross_links(members: DataFrame, sigs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links between different classes of one bucket, enough of them to join what belongs together.

    members: bucket, n, v, comp; sigs: v, sig; docs: v, text.
    """
    dealt = cut(_blocks(members).join(sigs, "v"))
    groups = 1 + dealt.count() // TOGETHER
    # small buckets share a group, blocks of large ones have groups of their own
    shared = F.when(F.col("small"), F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket"))
    keys = [shared.alias("g"), "i", "j"]

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bucket, own in group.groupby("bucket"):
            r, g = own[~own["guest"]], own[own["guest"]]
            hit_r, hit_g = _Pairs(bucket, r, g).needed()
            out += [r.iloc[hit_r], g.iloc[hit_g]]
        return pd.concat(out)[list(group.columns)] if out else group.iloc[:0]

    columns = ["bucket", "i", "j", "small", "v", "comp", "outside", "guest", "sig"]
    schema = dealt.select(*columns).schema
    promised = cut(dealt.select(*columns).groupBy(*keys).applyInPandas(lambda x: screen(x)[columns], schema))
    texts = _needed_texts(docs, promised.select("v").distinct())

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for bucket, own in group.groupby("bucket"):
            r, g = own[~own["guest"]], own[own["guest"]]
            sets_r, sets_g = _counts_of(list(r["text"])), _counts_of(list(g["text"]))
            found += _Pairs(bucket, r, g).links(sets_r, sets_g, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return promised.join(texts, "v").groupBy(*keys).applyInPandas(search, "a long, b long")


def near_classes(
    docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document with an id: doc_id, class_id (the smallest id of its class)."""
    light = cut(sketch(docs, id_col, text_col))
    heads = cut(light.groupBy("key").agg(F.min("doc_id").alias("v"), F.max("sig").alias("sig")))
    copies = cut(light.select("doc_id", "key").join(heads.select("key", "v"), "key").select("doc_id", "v"))
    # an id that has several texts is one document; its texts' vertices are linked
    several = copies.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b")
    same_id = copies.join(several.select("doc_id", "a"), "doc_id").where("v != a").select("a", F.col("v").alias("b"))

    held = _held(heads)
    buckets = held.groupBy("bucket").agg(
        F.min("v").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("who")
    )
    # of buckets with the same members one is enough, the first
    buckets = buckets.where("n > 1").groupBy("hub", "n", "who").agg(F.min("bucket").alias("bucket"))
    members = cut(held.join(cut(buckets.drop("who")), "bucket"))
    sigs = heads.where(F.octet_length("sig") > 0).select("v", "sig")
    texts = docs.select(F.col(id_col).cast("long").alias("v"), F.coalesce(text_col, F.lit("")).alias("text")).where("v is not null")

    pairs = members.where("v != hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
    links = cut(_verify(pairs, sigs, texts, similarity).unionByName(same_id))
    comps = components(links)
    # buckets of two were settled by their star
    placed = members.where("n > 2").join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
    # a table of its own, so that Spark can split a large bucket of the join
    todo = cut(placed.join(cut(mixed.select("bucket")), "bucket").select("bucket", "n", "v", "comp"))
    if not todo.isEmpty():
        more = cut(_cross_links(todo, sigs, texts, similarity))
        if not more.isEmpty():
            comps = components(links.unionByName(more))
    return (
        copies.join(comps, "v", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("comp", "v")).alias("class_id"))
        .join(copies.select("doc_id"), "doc_id")
    )


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their class's, once each, and those without an id.

    Of rows that share an id the one with the smallest text is kept, of rows with the same text the smallest
    in all columns that have an order, so reruns keep the same.
    """
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_id")).distinct()
    with_id = docs.join(kept, F.col(id_col) == F.col("_id"), "left_semi")
    repeated = classes.groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        ordered = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "array", "struct", "variant", "interval")]
        rest = [F.col(f"`{c}`").asc_nulls_last() for c in ordered if c not in (id_col, text_col)]
        place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last(), *rest))
        rows = with_id.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), place.alias("_place"))
        with_id = rows.where("_place = 1").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return with_id.unionByName(docs.where(F.col(id_col).isNull()))
