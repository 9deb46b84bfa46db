"""Ranked lexical search: WAND over shards of an inverted index.

The items' terms come to the driver in blocks of bounded size; each block is a pass over the documents.
Documents become rows of an index (id, length, the block's terms in it and how often) in the shared
folder, from which the collection's figures are summed. Each task then walks through its part of the
index in shards: a shard is turned into lists of (document, impact) by term, with each list's largest
impact. For an item, the lists stand at their next document and are ordered by it; the first place
where the largest impacts so far add up to what the item's heap asks for is the pivot, and no document
before the pivot's can enter the heap. All lists skip to it. Then a window of documents from the pivot
on is looked at together: documents whose lists' largest impacts don't reach the heap's threshold are
passed over, the others are scored. With a window of one document this is the textbook's WAND; a
wider one only makes the steps fewer. A heap stays with its task from shard to shard, so thresholds
rise, and the tasks' heaps are merged, some at a time, into each item's ranking. Nothing is left out:
a document is passed over only if its score could not enter.

Cases: texts that are null, empty or without terms count nowhere; repeated rows are documents of their
own, so they count in the figures and rank beside each other; a document without an id comes after
others of its score; the rows of one item id are one item; rows without an item id, items without
terms and terms that every document has (weight 0) give nothing; other columns don't matter.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, delete_path, map_columns, shared_path

BLOCK_TERMS = 50_000  #: terms of the items of a block, about; an item is never split
WINDOW = 2048  #: documents of a shard that are looked at together
MERGED = 128  #: tasks whose heaps are merged at once

_TERMS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; bytes.lower() changes A-Z alone."""
    return (text or b"").lower().translate(_TERMS).split()


def index_rows(ids: list, texts: list[bytes | None], number: dict[bytes, int]) -> dict[str, list]:
    """doc_id, n, terms (int32, ascending) and tf (int32) of the documents that have terms."""
    out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "tf": []}
    for doc_id, text in zip(ids, texts, strict=True):
        words = terms_of(text)
        if words:
            held, tf = np.unique(np.array([number[w] for w in words if w in number], np.int32), return_counts=True)
            for c, v in zip(out, (doc_id, len(words), held.tobytes(), tf.astype(np.int32).tobytes()), strict=True):
                out[c].append(v)
    return out


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths by row; row, term and tf of each entry."""
    parts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("terms", "tf")]
    sizes = [len(x) // 4 for x in batch.column("terms").to_pylist()]
    return batch.column("n").to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), *parts


def _figures(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and each term's df, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n, _, terms, _ = _rows(batch)
            held += np.bincount(terms, minlength=n_terms)
            documents, length = documents + len(n), length + int(n.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[documents, length], held[some]]))], names=["term", "n"]
        )

    summed = index.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in summed.collect()}  # a row a term of the block
    df = np.array([found.get(t, 0) for t in range(n_terms)], np.int64)
    return found.get(-2, 0), found.get(-1, 0), df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """w of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Heap:
    """The k best (score, id) of an item; ids descend in worth, and none is last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def needed(self) -> int:
        """The score that a document must have to enter, if its id is the smallest."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, n = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        best = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.none = s[best], i[best], n[best]


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], heap: Heap, ids: np.ndarray, none: np.ndarray, window: int = WINDOW) -> int:
    """Put a shard's best documents on the heap; gives the number of documents that were scored.

    lists: by term its documents (places in ids, ascending), their impacts and the largest of these.
    """
    scored, at = 0, [0] * len(lists)
    heads = np.array([docs[0] for docs, _, _ in lists], np.int64)
    tops = np.array([top for _, _, top in lists], np.int64)
    ended = len(ids)
    while True:
        order = np.argsort(heads, kind="stable")
        reach = np.cumsum(tops[order])
        first = int(np.searchsorted(reach, heap.needed()))
        if first == len(lists) or heads[order[first]] >= ended:
            return scored
        pivot = int(heads[order[first]])
        bound, pieces = np.zeros(window, np.int64), []
        for k in np.flatnonzero(heads < pivot + window).tolist():
            docs, impacts, top = lists[k]
            low, high = np.searchsorted(docs[at[k] :], (pivot, pivot + window)) + at[k]
            bound[docs[low:high] - pivot] += top
            pieces.append((docs[low:high] - pivot, impacts[low:high]))
            at[k], heads[k] = high, docs[high] if high < len(docs) else ended
        likely = np.flatnonzero(bound >= heap.needed())
        if len(likely):
            score = np.zeros(window, np.int64)
            for places, impacts in pieces:
                score[places] += impacts
            scored += len(likely)
            entering = likely[score[likely] >= heap.needed()]
            heap.add(score[entering], ids[pivot + entering], none[pivot + entering])


def _lists(batch: pa.RecordBatch, w: np.ndarray, documents: int, length: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """A shard: by term its documents, impacts and largest impact; ids and whether they are missing, by document."""
    n, row, terms, tf = _rows(batch)
    none = np.asarray(batch.column("doc_id").is_null())
    ids = batch.column("doc_id").fill_null(0).to_numpy()
    m = 100 - 50 + (50 * n * documents) // length
    tf = tf.astype(np.int64)
    impact = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    some = np.flatnonzero(impact > 0)
    some = some[np.argsort(terms[some], kind="stable")]
    row, terms, impact = row[some], terms[some], impact[some]
    edges = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1], [True]])) if len(terms) else [0]
    held = {int(terms[a]): (row[a:b], impact[a:b], int(impact[a:b].max())) for a, b in zip(edges, edges[1:], strict=False)}
    return held, ids, none


def _search(index: DataFrame, items: dict[int, list[int]], w: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id, score, part: the heaps of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {item: Heap(k) for item in items}
        for batch in batches:
            held, ids, none = _lists(batch, w, documents, length)
            for item, terms in items.items():
                lists = [held[t] for t in terms if t in held]
                if lists:
                    wand(lists, heaps[item], ids, none)
        for item, heap in heaps.items():
            if len(heap.scores):
                columns = [pa.array(np.full(len(heap.ids), item)), pa.array(heap.ids, mask=heap.none), pa.array(heap.scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long").withColumn("part", F.spark_partition_id())


def _blocks(items: DataFrame, item_id: str, item_text: str, block_terms: int) -> Iterator[dict[int, list[bytes]]]:
    """Items and their terms, at most about so many terms at a time."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        held = [(i, t) for i, text in zip(columns["item_id"], columns["text"], strict=True) for t in sorted(set(terms_of(text)))]
        return {"item_id": [i for i, _ in held], "term": [t for _, t in held]}

    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    terms = map_columns(named.where("item_id is not null"), run, "item_id long, term binary", 500)
    block, size = {}, 0
    for row in terms.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).toLocalIterator():
        block[row["item_id"]] = [bytes(t) for t in row["terms"]]
        size += len(row["terms"])
        if size >= block_terms:
            yield block
            block, size = {}, 0
    if block:
        yield block


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores for each item."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    spark, rankings = docs.sparkSession, []
    for block in _blocks(items, item_id, item_text, block_terms):
        number = {t: i for i, t in enumerate(sorted({t for terms in block.values() for t in terms}))}
        folder = shared_path(spark, f"index-{uuid.uuid4().hex}")
        try:
            made = map_columns(
                named, lambda c, number=number: index_rows(c["doc_id"], c["text"], number), "doc_id long, n long, terms binary, tf binary", 500
            )
            made.write.option("compression", "zstd").parquet(folder)
            index = spark.read.schema(made.schema).parquet(folder)
            documents, length, df = _figures(index, len(number))
            if documents:
                wanted = {item: [number[t] for t in terms] for item, terms in block.items()}
                found = _search(index, wanted, weights(df, documents), documents, length, k)
                # some heaps at a time, so that no task merges those of all shards
                for keys in (["item_id", F.floor(F.col("part") / MERGED)], ["item_id"]):
                    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
                    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                rankings.append(cut(found.select("item_id", "rank", "doc_id", "score")))
        finally:
            delete_path(spark, folder)
    if not rankings:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranking = rankings[0]
    for more in rankings[1:]:
        ranking = ranking.unionByName(more)
    return ranking
