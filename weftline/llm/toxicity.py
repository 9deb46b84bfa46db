"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a lexicon (whole words, beginnings of words, words with their obfuscation undone),
how near its hits are to second-person pronouns, capitals, punctuation, obfuscation and repetition rates.
The lexicon is learned too: words and beginnings of words that far more toxic than clean labelled
documents hold. Trees are grown on histograms of the features with logistic loss.

Everything is fitted on a sample of labelled documents of bounded size (`labelled_rows`, dealt by a hash
of the id) and cross-fitted by folds: a document's features come from a lexicon that other folds
made, and isotonic regression sees margins of trees that other folds grew, so neither the trees nor the
calibration see a lexicon or trees that know their rows. Final lexicon and trees use all folds. Every
document is scored on its whole text; a score's only input is the text.

Cases: a null text is an empty one and is scored; a document without an id is never held out and never
trains; rows that share an id are scored each, and the labels of an id count once (toxic if any says so);
without labels of both kinds every score is the share of toxic labels (0.5 without labels); repeated and
very long texts need nothing of their own; other columns, among them lang and source, don't matter.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import delete_path, map_columns, shared_path

FOLDS = 4  #: the remainders 1 to 4 of an id's checksum; remainder 0 is held out
ENTRIES = 20_000  #: words and beginnings that may enter a lexicon, the strongest ones
BEGINNINGS = (4, 5, 6, 7)  #: lengths of the beginnings of words
NEAR = 5  #: words around a second-person pronoun

#: Second-person pronouns in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves du dich dir dein deine deinen deiner euch euer eure tu te toi ton ta tes "
    "vous votre vos usted ustedes vosotros tus ti tuyo contigo".split()
)

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[\w@$!|+*.\-]+")
_BETWEEN = re.compile(r"[^\W\d_][\d@$!|+*._\-]+[^\W\d_]")  # letters with signs or digits between
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SHOUTED = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")
_PLAIN = str.maketrans("013457@$!|", "oieastasil", "*._-+")
_CACHED = 200_000  # words whose weights a worker keeps

STRONG = 5.0  #: log odds from which on an entry is strong

NAMES = (
    "strong_hits", "strong_density", "n_words", "mean_length", "hits", "hit_density", "weight_density", "strongest", "distinct_hits", "whole_hits",
    "whole_density", "masked", "masked_density", "masked_hits", "second_person", "near_hits", "nearest", "capitals",
    "shouted", "exclamations", "questions", "signs", "punctuation", "digits", "stretched", "distinct_share",
    "commonest_share", "lines",
)


@dataclass(frozen=True)
class Lexicon:
    """Weights (log odds) of whole words and of beginnings of words."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> tuple[float, bool]:
        """A word's weight, 0 if it has none, and whether the whole word is an entry."""
        own = self.words.get(word)
        if own is not None:
            return own, True
        return max((self.beginnings.get(word[:k], 0.0) for k in BEGINNINGS if k < len(word)), default=0.0), False


def undone(token: str) -> str:
    """A word without signs and digits that stand for letters or between them."""
    return token.lower().translate(_PLAIN)


def masked_tokens(text: str) -> list[str]:
    """Tokens that have signs or digits between letters."""
    return [t for t in _TOKEN.findall(text) if _BETWEEN.search(t)] if _BETWEEN.search(text) else []


def keys_of(text: str | None) -> set[str]:
    """What a text has for a lexicon: =word and ^beginning."""
    words = set(_WORD.findall((text or "").lower()))
    words |= {undone(t) for t in set(masked_tokens(text or ""))} - {""}
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in BEGINNINGS if k < len(w)}


def text_features(text: str | None, lexicon: Lexicon, cache: dict[str, tuple[float, bool]]) -> list[float]:
    """The features of one text, in the order of NAMES; cache: weights of words that were met before."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n = len(words)
    counts = Counter(words)
    if len(cache) > _CACHED:
        cache.clear()
    hit: dict[str, float] = {}
    whole = 0
    for w in counts:
        found = cache.get(w)
        if found is None:
            found = cache[w] = lexicon.weight(w)
        if found[0]:
            hit[w] = found[0]
            whole += found[1] * counts[w]
    masked = masked_tokens(text)
    unmasked = [w for w in map(undone, masked) if lexicon.weight(w)[0]]
    for w in unmasked:  # what a masked word stands for is a hit like others
        hit[w] = lexicon.weight(w)[0]
        counts[w] += 1
    hits = sum(counts[w] for w in hit)
    strong = sum(counts[w] for w, v in hit.items() if v >= STRONG)
    near, nearest, second = 0, 100.0, sum(counts[w] for w in SECOND_PERSON & counts.keys())
    at = np.array([i for i, w in enumerate(words) if w in hit]) if second and hit else np.zeros(0)
    if len(at):
        persons = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        after = np.searchsorted(persons, at)
        gap = np.minimum(
            np.abs(at - persons[np.minimum(after, len(persons) - 1)]), np.abs(at - persons[np.maximum(after - 1, 0)])
        )
        near, nearest = int((gap <= NEAR).sum()), float(gap.min())
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    capitals, small, digits = int(data[65:91].sum()), int(data[97:123].sum()), int(data[48:58].sum())
    signs = int(sum(data[c] for c in b"#$%&*@^~|"))
    punctuation = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
    size, some = max(1, int(data.sum())), max(1, n)
    return [
        strong, strong / some, math.log1p(n), sum(map(len, words)) / some, hits, hits / some, sum(v * counts[w] for w, v in hit.items()) / some,
        max(hit.values(), default=0.0), len(hit), whole, whole / some, len(masked), len(masked) / some, len(unmasked), second / some,
        near, nearest, capitals / max(1, capitals + small), len(_SHOUTED.findall(text)) / some, data[33] / size, data[63] / size,
        signs / size, punctuation / size, digits / size, len(_STRETCHED.findall(text)) / some, len(counts) / some,
        max(counts.values(), default=0) / some, math.log1p(int(data[10])),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth: per tree and inner node a feature and a threshold, per leaf a value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of rows of features."""
        n_trees = len(self.feature)
        node = np.zeros((len(x), n_trees), np.int64)
        inner = self.feature.shape[1] if n_trees else 0
        which = np.arange(n_trees)
        while inner and node[0, 0] < inner if len(x) else False:
            right = x[np.arange(len(x))[:, None], self.feature[which, node]] > self.threshold[which, node]
            node = 2 * node + 1 + right
        return self.base + (self.value[which, node - inner].sum(1) if n_trees else 0.0)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 4.0) -> Trees:
    """Boosted trees with logistic loss, on histograms of at most so many bins a feature."""
    n, width = x.shape
    prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(prior / (1 - prior))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)])
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, 2**depth))
    margin = np.full(n, base)
    cells = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + cells).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, width), count * width * bins).reshape(count, width, bins) for v in (g, h))
            left_g, left_h = np.cumsum(gs, 2), np.cumsum(hs, 2)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            own = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), own] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        margin += value[t, leaf]
    return Trees(base, feature, threshold, value)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, share of toxic rows) of the nondecreasing fit: pool adjacent violators."""
    blocks: list[list[float]] = []  # sum of margins, sum of labels, rows
    order = np.argsort(margin, kind="stable")
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass(frozen=True)
class Model:
    """All that scores a text: bounded by ENTRIES and by the parameters of the trees."""

    prior: float
    lexicon: Lexicon = field(default_factory=Lexicon)
    trees: Trees | None = None
    at: np.ndarray | None = None
    share: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        m = self.trees.margin(x)
        # a little of the margin tells apart what the isotonic fit holds equal
        return 0.999 * np.interp(m, self.at, self.share) + 0.001 / (1 + np.exp(-m))


def fold_of(doc_id: Column) -> Column:
    """The checksum of an id as text, modulo 5; null without an id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def _lexicons(sample: DataFrame, size: tuple[np.ndarray, np.ndarray]) -> list[Lexicon]:
    """Lexicons without each fold (1 to FOLDS), and at place 0 that of all. size: toxic and clean rows by fold."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        held: dict[str, list[int]] = {}
        for text, fold, toxic in zip(columns["text"], columns["fold"], columns["toxic"], strict=True):
            slot = 2 * (fold - 1) + toxic
            for key in keys_of(text):
                held.setdefault(key, [0] * (2 * FOLDS))[slot] += 1
        return {"key": list(held)} | {f"c{i}": [v[i] for v in held.values()] for i in range(2 * FOLDS)}

    slots = [f"c{i}" for i in range(2 * FOLDS)]
    counts = map_columns(sample, run, "key string, " + ", ".join(f"{c} long" for c in slots), 500)
    toxic, clean = sum(F.col(c) for c in slots[1::2]), sum(F.col(c) for c in slots[::2])
    odds = F.log((toxic + 0.5) / (size[0].sum() + 1)) - F.log((clean + 0.5) / (size[1].sum() + 1))
    summed = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in slots]).withColumn("odds", odds)
    # at most ENTRIES rows
    best = summed.where((toxic >= 4) & (F.col("odds") >= 1.5)).orderBy(F.desc(F.col("odds") * F.log1p(toxic)), "key").limit(ENTRIES)
    rows = [(r["key"], np.array([r[c] for c in slots])) for r in best.collect()]
    out = []
    for left_out in range(FOLDS + 1):
        use = np.array([f + 1 != left_out for f in range(FOLDS)])
        n_toxic, n_clean = size[0][use].sum(), size[1][use].sum()
        kinds: dict[str, dict[str, float]] = {"=": {}, "^": {}}
        for key, c in rows:
            a, b = c[1::2][use].sum(), c[::2][use].sum()
            weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
            if a >= 3 and weight >= 1.5:
                kinds[key[0]][key[1:]] = weight
        out.append(Lexicon(kinds["="], kinds["^"]))
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    labelled_rows: int = 8_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on at most so many labelled ids; ids whose checksum is 0 modulo 5 are never used."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")).where("toxic is not null")
    known = known.withColumn("fold", fold_of(F.col("doc_id"))).where("fold > 0").groupBy("doc_id", "fold")
    known = known.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    folder = shared_path(spark, f"toxicity-{uuid.uuid4().hex}")
    try:
        named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        # at most labelled_rows ids; rows that share an id train once, with their smallest text
        found = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "fold", "toxic").agg(F.min("text").alias("text"))
        found.write.option("compression", "zstd").parquet(folder)
        sample = spark.read.schema("doc_id long, fold int, toxic int, text string").parquet(folder)
        by_fold = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
        size = tuple(np.array([by_fold.get((f + 1, t), 0) for f in range(FOLDS)]) for t in (1, 0))
        if not size[0].sum() or not size[1].sum():
            return Model(float(size[0].sum() / (size[0].sum() + size[1].sum())) if size[0].sum() + size[1].sum() else 0.5)
        lexicons = _lexicons(sample, size)

        def run(columns: dict[str, list]) -> dict[str, list]:
            caches = [{} for _ in lexicons]
            rows = [text_features(t, lexicons[f], caches[f]) for t, f in zip(columns["text"], columns["fold"], strict=True)]
            return {c: columns[c] for c in ("doc_id", "fold", "toxic")} | {"x": [np.array(r, np.float32).tobytes() for r in rows]}

        made = map_columns(sample, run, "doc_id long, fold int, toxic int, x binary", 500).orderBy("doc_id").toArrow()
        x = np.frombuffer(b"".join(made["x"].to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(np.float64)
        y, fold = made["toxic"].to_numpy().astype(np.float64), made["fold"].to_numpy()
        margin = np.zeros(len(y))
        for f in range(1, FOLDS + 1):
            if (fold == f).any():
                rest = fold != f if 0 < y[fold != f].sum() < (fold != f).sum() else np.ones(len(y), bool)
                margin[fold == f] = grow(x[rest], y[rest]).margin(x[fold == f])
        return Model(float(y.mean()), lexicons[0], grow(x, y), *isotonic(margin, y))
    finally:
        delete_path(spark, folder)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; hits and masked words as features that explain a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, bool]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                rows = [text_features(t, model.lexicon, cache) for t in piece.column("text").to_pylist()]
                x = np.array(rows, np.float64).reshape(-1, len(NAMES)).astype(np.float32).astype(np.float64)
                score = np.clip(model.scores(x), 0.0, 1.0)
                hits, near = (pa.array(x[:, NAMES.index(c)].astype(np.int64)) for c in ("hits", "near_hits"))
                predicted = pa.array((score >= 0.5).astype(np.int32))
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(score), predicted, hits, near]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_hits", "n_near"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = named.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return named.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_near long")
