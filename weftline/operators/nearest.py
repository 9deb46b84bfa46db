"""Exact k nearest by inner product: blocks of vectors multiplied with blocks of queries, and blocks that bounds rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.folders import cut, delete_folder, shared_folder

SAMPLE = 4096  #: vectors from which the cells' centres are taken, at most
PER_CELL = 2000  #: vectors of a cell, about
BLOCK = 4096  #: vectors or queries of a block, about
FIRST = 2  #: cells that a query searches to get its threshold

ROWS = "id long, q boolean, v binary"  # what is kept of the vectors


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """id, q, v: the vectors as doubles, without those that are null, empty or zero or hold a null or non-finite value."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    some = named.where(F.col("id").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda y: y != 0))

    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float64).tobytes() for v in x], dtype=object)

    return some.select("id", F.coalesce("q", F.lit(False)).alias("q"), F.pandas_udf(packed, "binary")("x").alias("v"))


def _cells(table: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cell (that of the nearest centre), norm and far (the distance from the centre)."""
    half = (centres**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                x = _matrix(piece.column("v").to_pylist())
                cell = (x @ centres.T - half).argmax(1)
                far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                columns = [*piece.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt((x**2).sum(1))), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "cell", "norm", "far"])

    return table.mapInArrow(run, "id long, v binary, cell int, norm double, far double")


def _visits(queries: DataFrame, centres: np.ndarray, figures: dict[str, np.ndarray], later: bool) -> DataFrame:
    """id, v, least, cell: the cells that a query (id, v, least) searches, FIRST of them or later all others that its bounds allow.

    A vector's product is at most that of the query with the centre plus the query's norm times the
    cell's radius, and at most the product of both norms (both by Cauchy-Schwarz).
    """
    there = np.flatnonzero(figures["n"] > 0)
    own, radius, norm = centres[there], figures["far"][there], figures["norm"][there]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                q = _matrix(piece.column("v").to_pylist())
                size = np.sqrt((q**2).sum(1))[:, None]
                bound = np.minimum(q @ own.T + size * radius, size * norm)
                order = np.argsort(-bound, axis=1, kind="stable")
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order[:, :FIRST], True, axis=1)
                least = piece.column("least").to_numpy()[:, None]
                row, cell = np.nonzero(~first & (bound * (1 + 1e-9) + 1e-9 >= least) if later else first)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c).take(pa.array(row)) for c in ("id", "v", "least")] + [pa.array(there[cell].astype(np.int32))],
                    names=["id", "v", "least", "cell"],
                )

    return queries.mapInArrow(run, "id long, v binary, least double, cell int")


def _products(vectors: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of each pair of blocks the k best of each query, and none below its threshold.

    Vectors of a cell (id, v, cell) are dealt to blocks, and so are the queries that visit it; each
    vector goes to each block of queries once and the other way round.
    """
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    guests = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("guest_parts"))
    # a row a cell: as many as centres
    grid = F.broadcast(cut(sizes.join(guests, "cell")))
    every = "explode(sequence(0, {} - 1))"
    own = "cast(pmod(xxhash64(id), {}) AS int)"
    dealt = vectors.join(grid, "cell").select("cell", F.expr(own.format("parts")).alias("i"), F.expr(every.format("guest_parts")).alias("j"), "id", "v")
    asked = visits.join(grid, "cell").select(
        "cell", F.expr(every.format("parts")).alias("i"), F.expr(own.format("guest_parts")).alias("j"), "id", "v", "least"
    )

    def multiply(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            x, ids = _matrix(list(own["v"])), own["id"].to_numpy()
            for at in range(0, len(asked), 256):
                some = asked.iloc[at : at + 256]
                q, q_ids, least = _matrix(list(some["v"])), some["id"].to_numpy(), some["least"].to_numpy()
                score = q @ x.T
                if score.shape[1] > k:
                    least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
                row, column = np.nonzero(score >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
                # the products once more, added up in one order, so that equal vectors have equal scores
                exact = np.zeros(len(row))
                for d in range(x.shape[1]):
                    exact += q[row, d] * x[column, d]
                found.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": ids[column], "score": exact}))
        out = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["cell", "i", "j"]
    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(multiply, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their ranks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors of other ids with the largest inner product; ties to smaller ids.

    Vectors are dealt to the cells of centres that a sample gives, so a cell has a small radius. A
    query searches FIRST cells, whose best scores give its threshold; of the other cells it visits those
    whose bound reaches the threshold, so the result is exact whatever the sample. Cells and the queries
    that visit them meet in blocks of bounded size, as matrix products, and of a pair of blocks only the
    best of a query go on; they are merged by query. No pair is listed that is not among them. Of equal
    vectors only the k + 1 with the smallest ids can be found, so no more are searched, and equal queries
    are searched once; so a vector that a third of all rows have costs no more than another.

    Cases: vectors that are null, empty or zero or hold null or non-finite values, and rows without an id,
    take no part; all vectors must be of one length; rows of one id are one vector, the first in the order
    of their bytes; queries with fewer than k candidates list all; other columns don't matter.
    """
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession, "vectors")
    try:
        one = clean_vectors(vectors, id_col, vector_col, is_query).groupBy("id").agg(F.max("q").alias("q"), F.min("v").alias("v"))
        one.write.parquet(folder)
        table = spark.read.schema(ROWS).parquet(folder)
        place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        found = table.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v")
        asked = table.where("q").groupBy("v").agg(F.min("id").alias("id"))
        # at most SAMPLE vectors, dealt by a hash
        wanted = max(1, min(SAMPLE, -(-table.count() // PER_CELL)))
        sample = found.orderBy(F.xxhash64("v"), "id").limit(wanted).collect()
        if not sample:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        centres = np.unique(_matrix([r["v"] for r in sample]), axis=0)
        celled = cut(_cells(found, centres))
        rows = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
        figures = {c: np.zeros(len(centres)) for c in ("n", "far", "norm")}
        for r in rows:  # a row a centre
            for c in figures:
                figures[c][r["cell"]] = r[c]
        own = celled.select("id", "v", "cell")
        near = _visits(asked.select("id", "v", F.lit(float("-inf")).alias("least")), centres, figures, later=False)
        first = cut(_best(_products(own, near, k + 1), k + 1).select("query_id", "vec_id", "score", "rank"))
        least = first.where(F.col("rank") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        known = asked.join(least, "id", "left").select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        more = _products(own, cut(_visits(known, centres, figures, later=True)), k + 1)
        ranked = _best(first.drop("rank").unionByName(more), k + 1).withColumnRenamed("query_id", "first_id")
        # every query gets the ranking of its vector, without itself
        named = table.where("q").select(F.col("id").alias("query_id"), "v").join(asked.select("v", F.col("id").alias("first_id")), "v")
        others = named.select("query_id", "first_id").join(ranked.drop("rank"), "first_id").where("vec_id != query_id")
        return cut(_best(others, k).select("query_id", "rank", "vec_id", "score"))
    finally:
        delete_folder(spark, folder)
