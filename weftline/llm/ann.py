"""Approximate nearest neighbours by inner product, with score-aware quantisation.

Vectors are dealt to cells: a coarse centre (k-means), and for large tables a second centre for
what is left, so that the number of cells grows with the table beyond what a sample can train. The
difference to the cell's centre is coded in 4 bits for every two dimensions. The codes and
codebooks minimise an anisotropic loss: the part of the error along the vector itself, which shifts
large inner products, costs more than the part across it. A search looks into the cells with the
largest inner products of centre and query, scans the codes there by table look-ups, and reranks
the best of them exactly on the original vectors.

Cells that lie near each other make up blocks of about BLOCK vectors; a cell that is larger is
several blocks. Every vector is sent to its block once, and a query once to each block that holds a
cell it probes. A task holds one block and reads its queries as a stream.

Centres and codebooks are fitted on a bounded sample (`sample_rows`, the rows with the smallest
hashes); every vector is indexed. How many cells are probed, and how far a candidate's rough score may
be off to be reranked, is measured on a bounded sample of the queries against the sample by brute force,
so queries may be unlike the vectors. Vectors that the codes describe worse than nearly all of the
sample (about OUTLYING of it) lie in a cell of their own, which every query probes exactly. Equal vectors are indexed once, with as many of their
smallest ids as an answer can need, so a vector that fills a third of the table is one entry. Equal
query vectors are searched once. Repeated rows (the same id and vector) count once, as candidates
and as queries.

Cases: null vectors, zero vectors, those with null or non-finite components and those whose
length differs from that of most take no part; rows without an id neither; fewer than k
candidates give all of them; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

BLOCK = 16_384  #: distinct vectors, about, that a task holds at once
FINE = 64  #: second centres for each coarse one at most
AT_ONCE = 256  #: queries that are answered together
ASKED = 512  #: queries by which probes and margin are measured
OUTLYING = 1 / 1000  #: share of the sample whose codes err most


@dataclass
class Index:
    """What all tasks need: its size depends on the sample alone."""

    coarse: np.ndarray  # centres x dims
    fine: np.ndarray  # second centres x dims
    books: np.ndarray  # subspaces x 16 x 2
    parallel: float  # extra weight of the error along the vector
    first: np.ndarray | None = None  # per cell: its first block
    splits: np.ndarray | None = None  # per cell: the blocks it is dealt to
    probes: int = 1
    margin: float = math.inf  # by which a rough score may be off, for a query of length 1
    outlying: float = math.inf  # error of the codes beyond which a vector is in the last cell
    size: float = 1.0  # length of the sample's longest vector

    @property
    def centres(self) -> np.ndarray:
        """Of all cells."""
        return (self.coarse[:, None] + self.fine[None]).reshape(-1, self.coarse.shape[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        near = _nearest(x, self.coarse)
        return near * len(self.fine) + (_nearest(x - self.coarse[near], self.fine) if len(self.fine) > 1 else 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate(
        [np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, int)]
    )


def encode(residual: np.ndarray, unit: np.ndarray, books: np.ndarray, parallel: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on |e|^2 + parallel * <e, unit>^2."""
    n, subs = len(residual), len(books)
    r, u = residual.reshape(n, subs, 2), unit.reshape(n, subs, 2)
    codes = np.zeros((n, subs), np.int64)
    along = np.zeros((n, subs))
    rows = np.arange(n)
    for sweep in range(sweeps + 1):
        for m in range(subs):
            e = r[:, m, None, :] - books[m][None]
            cost, side = (e * e).sum(2), (e * u[:, m, None, :]).sum(2)
            if sweep:
                others = along.sum(1) - along[:, m]
                cost = cost + parallel * (others[:, None] + side) ** 2
            codes[:, m] = cost.argmin(1)
            along[:, m] = side[rows, codes[:, m]]
    return codes


def fit(x: np.ndarray, cells: int, threshold: float = 0.2, rounds: int = 6) -> Index:
    """Centres and codebooks from sample rows (dims even). A coarse centre has 16 sample rows or more on average."""
    x = x.astype(np.float64)
    dims = x.shape[1]
    coarse = _kmeans(x, max(1, min(cells, len(x) // 16)))
    left = x - coarse[_nearest(x, coarse)]
    n_fine = min(FINE, -(-cells // len(coarse)))
    fine = _kmeans(left, n_fine) if n_fine > 1 and len(x) >= 16 * n_fine else np.zeros((1, dims))
    index = Index(coarse, fine, np.zeros((dims // 2, 16, 2)), 0.0)
    residual = x - index.centres[index.cell(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    # weights for scores above `threshold` of the vectors' lengths
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    parallel = eta - 1
    r, u = residual.reshape(len(x), -1, 2), unit.reshape(len(x), -1, 2)
    books = np.stack([_kmeans(np.ascontiguousarray(r[:, m]), min(16, len(x))) for m in range(r.shape[1])])
    if books.shape[1] < 16:
        books = np.concatenate([books, np.repeat(books[:, :1], 16 - books.shape[1], axis=1)], axis=1)
    for _ in range(rounds):
        codes = encode(residual, unit, books, parallel)
        e = r - books[np.arange(len(books))[None], codes]
        along = (e * u).sum(2)
        for m in range(len(books)):
            others = along.sum(1) - along[:, m]
            want = r[:, m] + parallel * u[:, m] * (others + (r[:, m] * u[:, m]).sum(1))[:, None]
            outer = parallel * u[:, m, :, None] * u[:, m, None, :] + np.eye(2)
            for k in range(16):
                at = codes[:, m] == k
                if at.any():
                    books[m, k] = np.linalg.solve(outer[at].sum(0), want[at].sum(0))
            along[:, m] = ((r[:, m] - books[m, codes[:, m]]) * u[:, m]).sum(1)
    index.books, index.parallel = books, parallel
    return index


def decode(index: Index, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors as cells and codes describe them."""
    return index.centres[cell] + np.take_along_axis(index.books, codes.T[:, :, None], 1).transpose(1, 0, 2).reshape(len(codes), -1)


def errors(index: Index, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x - decode(index, cell, codes), axis=1)


def measure(index: Index, x: np.ndarray, queries: np.ndarray, k: int, coverage: float) -> None:
    """Set outlying, probes and margin by brute force for some queries: the cells that hold `coverage` of the k nearest
    of all queries, and 9 in 10 of those of `coverage` of the queries, and the error that as many of the rough scores keep."""
    index.size = float(np.linalg.norm(x, axis=1).max()) if len(x) else 1.0
    cells = len(index.centres)
    cell = index.cell(x)
    codes = encode(x - index.centres[cell], x / np.linalg.norm(x, axis=1, keepdims=True), index.books, index.parallel)
    off = errors(index, x, cell, codes)
    index.outlying = float(np.sort(off)[-1 - int(len(x) * OUTLYING)]) if len(x) else math.inf
    inner = off <= index.outlying
    x, cell, decoded = x[inner], cell[inner], decode(index, cell[inner], codes[inner])
    own = {v.tobytes(): i for i, v in enumerate(x)}
    index.probes, index.margin = cells, math.inf
    if len(x) < 2 or not len(queries):
        return
    places, wrong, kept = [], [], min(k, len(x) - 1)
    for q in np.array_split(queries / np.linalg.norm(queries, axis=1, keepdims=True), -(-len(queries) // 64)):
        exact = q @ x.T
        for i, v in enumerate(queries[sum(map(len, places)) :][: len(q)]):
            if v.tobytes() in own:
                exact[i, own[v.tobytes()]] = -np.inf
        true = np.argpartition(-exact, kept - 1, axis=1)[:, :kept]
        place = np.argsort(np.argsort(-(q @ index.centres.T), axis=1, kind="stable"), axis=1)
        places.append(np.sort(np.take_along_axis(place, cell[true], axis=1), axis=1) + 1)
        found = np.take_along_axis(exact, true, axis=1)
        wrong.append(np.abs(found - np.einsum("qd,qkd->qk", q, decoded[true])).ravel())
    ranks = np.concatenate(places)

    def at_least(values: np.ndarray) -> float:
        return np.sort(values.ravel())[min(values.size - 1, math.ceil(coverage * values.size))]

    index.probes = int(max(at_least(ranks), at_least(ranks[:, math.ceil(0.9 * kept) - 1])))
    index.margin = float(at_least(np.concatenate(wrong))) / index.size


def lay_out(index: Index, sample_cells: np.ndarray, n: int) -> None:
    """Deal the cells to blocks by the sizes that the sample lets expect, near cells together."""
    expected = np.bincount(sample_cells, minlength=len(index.coarse) * len(index.fine)) * (n / max(1, len(sample_cells)))
    outside = max(1, math.ceil(n * OUTLYING / BLOCK))
    near = _nearest(index.coarse, _kmeans(index.coarse, math.isqrt(len(index.coarse))))
    order = np.argsort(np.repeat(near, len(index.fine)), kind="stable")
    index.first, index.splits = np.zeros(len(order), np.int64), np.maximum(1, np.ceil(expected / BLOCK)).astype(np.int64)
    block, filled = 0, 0.0
    for c in order:
        if filled and (index.splits[c] > 1 or filled + expected[c] > BLOCK):
            block, filled = block + 1, 0.0
        index.first[c] = block
        filled += expected[c]
        if index.splits[c] > 1:
            block, filled = block + int(index.splits[c]), 0.0
    index.first, index.splits = np.append(index.first, block + 1), np.append(index.splits, outside)


def scan(index: Index, centre: np.ndarray, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate scores (queries x rows): a look-up of 16 entries for each 4-bit code."""
    tables = np.einsum("qmd,mkd->qmk", queries.reshape(len(queries), -1, 2), index.books).astype(np.float32)
    out = np.repeat((queries @ centre).astype(np.float32)[:, None], len(codes), axis=1)
    for m in range(codes.shape[1]):
        out += tables[:, m][:, codes[:, m]]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0)


def _index_rows(index, dims: int):
    """Entries (v, ids) to (block, cell, codes, v, ids); index: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index = index.value
        centres = held.centres
        for batch in batches:
            x = _even(_matrix(batch.column("v"), dims))
            cell = held.cell(x)
            codes = encode(x - centres[cell], x / np.linalg.norm(x, axis=1, keepdims=True), held.books, held.parallel)
            off = errors(held, x, cell, codes)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
            packed = codes[:, 0::2] | codes[:, 1::2] << 4
            cell = np.where(off > held.outlying, len(centres), cell)
            block = held.first[cell].copy()
            for i in np.flatnonzero(held.splits[cell] > 1):
                block[i] += zlib.crc32(x[i].tobytes()) % int(held.splits[cell[i]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(cell.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), *batch.columns],
                names=["block", "cell", "codes", "v", "ids"],
            )

    return run


def _probe_rows(index, dims: int):
    """Queries (qid, v) to (block, probes, v, qid), one row for each block that holds probed cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index = index.value
        centres = held.centres
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                q = _even(_matrix(part.column("v"), dims))
                near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, : held.probes]
                near = np.pad(near, ((0, 0), (0, 1)), constant_values=len(centres))  # and the last cell
                who = np.repeat(np.arange(len(q)), near.shape[1])
                near = near.ravel()
                splits = held.splits[near]
                block = np.repeat(held.first[near], splits) + np.arange(splits.sum()) - np.repeat(np.cumsum(splits) - splits, splits)
                who, near = np.repeat(who, splits), np.repeat(near, splits).astype(np.int32)
                order = np.lexsort((block, who))
                who, near, block = who[order], near[order], block[order]
                new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (block[1:] != block[:-1])]))
                own = pa.array(who[new])
                probes = pa.ListArray.from_arrays(pa.array(np.append(new, len(near)).astype(np.int32)), pa.array(near))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[new]), probes, part.column("v").take(own), part.column("qid").take(own)],
                    names=["block", "probes", "v", "qid"],
                )

    return run


def _answers(index, dims: int, k: int, rerank: int):
    """Rows ordered by block, each block's vectors before its queries, to each query's best there: qid, score, ids."""

    def answer(rows: pa.Table, asks: pa.RecordBatch) -> pa.RecordBatch:
        held: Index = index.value
        packed = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(rows.num_rows, -1)[:, : len(held.books)]
        x, cell = _matrix(rows["v"], dims), rows["cell"].to_numpy()
        outer = len(held.centres)
        by_cell = {c: np.flatnonzero(cell == c) for c in np.unique(cell).tolist()}
        keep, few = min(rerank, len(x)), min(k + 1, len(x))
        out_q, out_s, out_rows = [], [], []
        for a in range(0, asks.num_rows, AT_ONCE):
            part = asks.slice(a, AT_ONCE)
            q, probing = _matrix(part.column("v"), dims), part.column("probes")
            unit = _even(q) / (np.linalg.norm(q, axis=1, keepdims=True) * held.size)
            wanted = probing.flatten().to_numpy()
            who = np.repeat(np.arange(len(q)), probing.value_lengths().to_numpy())
            rough = np.full((len(q), len(x)), -np.inf, np.float32)
            for c, at in by_cell.items():
                asking = who[wanted == c]
                if len(asking) and c == outer:  # no codes describe these
                    rough[np.ix_(asking, at)] = unit[asking] @ _even(x[at]).T
                elif len(asking):
                    centre = held.coarse[c // len(held.fine)] + held.fine[c % len(held.fine)]
                    rough[np.ix_(asking, at)] = scan(held, centre, codes[at], unit[asking])
            # the best by codes, and all that may be among the k best if scores are off by the margin
            sure = np.partition(rough, (len(x) - few, len(x) - keep), axis=1)
            least = np.minimum(sure[:, len(x) - few] - 2 * held.margin, sure[:, len(x) - keep])
            chosen = (rough >= least[:, None]) & (rough > -np.inf)
            some = np.flatnonzero(chosen.any(axis=0))
            if not len(some):
                continue
            exact = q @ x[some].T
            exact[~chosen[:, some]] = -np.inf
            best = np.argsort(-exact, axis=1, kind="stable")[:, :few]
            real = np.take_along_axis(exact, best, 1) > -np.inf
            score = np.einsum("qd,qkd->qk", q, x[some[best]])
            out_q.append(np.repeat(part.column("qid").to_numpy(), real.sum(1)))
            out_rows.append(some[best][real])
            out_s.append(score[real])
        if not out_q:
            return pa.RecordBatch.from_pydict({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": rows["ids"].combine_chunks()[:0]})
        ids = rows["ids"].combine_chunks().take(pa.array(np.concatenate(out_rows)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_s)), ids], names=["qid", "score", "ids"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, whole = None, [], None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, (now, asks) = batch.slice(a, b - a), divmod(int(keys[a]), 2)
                if now != block:
                    block, held, whole = now, [], None
                if not asks:
                    held.append(part)
                elif held or whole is not None:
                    whole = pa.Table.from_batches(held) if whole is None else whole
                    yield answer(whole, part)

    return run


def search(
    table: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_a_cell: int = 400,
    coverage: float = 0.97,
    rerank: int = 200,
    sample_rows: int = 20_000,
    exact: bool = False,
) -> DataFrame:
    """For each row that `queries` (a condition on the id, named vec_id) selects: its k nearest other rows.

    coverage: the part of the true neighbours that the probed cells must hold, and of rough scores that the
    margin must hold, measured on ASKED of the queries; rerank: candidates of a block at least. exact: all cells
    are probed and all their vectors reranked, so nothing is lost, at the cost of comparing all.
    Columns: query_id, rank, vec_id, score.
    """
    spark = table.sparkSession
    kind = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    raw = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    raw = raw.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    common = raw.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], out_schema)
    dims = common["n"]
    zero = F.lit(0.0).cast(kind)
    raw = raw.where(F.size("v") == dims).withColumn("v", F.transform("v", lambda c: c + zero))  # -0.0 to 0.0
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    # no answer needs more of a group of equal vectors than its k + 1 smallest ids
    entries = cut(
        raw.withColumn("n", F.dense_rank().over(by_vector))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    n_entries = entries.count()
    sample = _even(
        _matrix(entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).toArrow()["v"], dims)
    )
    fitted = fit(sample, max(1, min(round(math.sqrt(n_entries)), n_entries // rows_a_cell)))
    lay_out(fitted, fitted.cell(sample), n_entries)
    asked = raw.where(queries).distinct()
    some = asked.select("v").distinct().orderBy(F.xxhash64("v", F.lit(1)), "v").limit(ASKED)
    measure(fitted, sample, _even(_matrix(some.toArrow()["v"], dims)), k, coverage)
    if exact:
        fitted.probes, fitted.margin = len(fitted.centres), math.inf
    index = spark.sparkContext.broadcast(fitted)

    vectors = entries.mapInArrow(_index_rows(index, dims), f"block long, cell int, codes binary, v array<{kind}>, ids array<bigint>")
    # one search for each distinct query vector, under the smallest id that asks it
    leaders = cut(asked.join(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "v"))
    probed = (
        leaders.where("qid = vec_id")
        .select("qid", "v")
        .mapInArrow(_probe_rows(index, dims), f"block long, probes array<int>, v array<{kind}>, qid bigint")
    )
    both = vectors.withColumn("asks", F.lit(0)).unionByName(probed.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    met = (
        both.repartition("block")
        .sortWithinPartitions("block", "asks")
        .mapInArrow(_answers(index, dims, k, rerank), "qid bigint, score double, ids array<bigint>")
    )
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0]))
    found = met.withColumn("n", first).where(F.col("n") <= k + 1).select("qid", "score", "ids")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        leaders.select("qid", F.col("vec_id").alias("query_id"))
        .join(found, "qid")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id != query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
