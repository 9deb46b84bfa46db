"""Sharding by extendible hashing.

A row's hash bits are the first bits of md5(id). The directory is indexed by a prefix of these
bits. A bucket that exceeds the byte limit splits on its next bit; other buckets stay whole, so a
shard is named by a prefix of its own length (its local depth). Bytes are summed by the cells of
a directory that is a few bits deeper than the shards need on average; every prefix of a cell
gets its sum from there, and the shard of a cell is its shortest prefix that fits. A cell that is
still too large goes into another round with more bits, by itself.

Rows that share every hash bit (rows with one id) can't be told apart by more bits. Their bucket
keeps overflow pages: the rows are dealt to chunks, and a chunk's rows to pages by running byte
count, so each page fits too; rows of more than half the limit have pages of their own. A row that
alone exceeds the limit is the only row that may make a shard larger than the limit.

Cases: null text has 0 bytes; null ids hash as the empty string; repeated rows go to overflow
pages where needed; an empty table gives an empty result; `write_shards` keeps all columns and
every row as often as it occurs, and names the folders' column `shard`, with underscores in front
while a column of the documents has that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

BITS = 60  #: hash bits that a prefix can use
EXTRA_BITS = 3  #: bits by which a directory is deeper than log2(bytes / limit)
CHUNK = 1 << 12  #: rows of one id that are ordered together when overflow pages are made


def _prefix(depth):
    """The first `depth` (a number or a column) of the hash bits, as a number."""
    return F.expr(f"shiftright(h, cast({BITS} - ({depth}) as int))")


def _round(rows: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """The cells of the rows' directory at `depth`, with the local depth of the shard that holds each.

    Cells that no prefix of up to `depth` bits makes small enough have a null local depth.
    """
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
    cells = cut(cells)
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn(
        "p", F.expr(f"shiftright(cell, {depth} - d)")
    )
    fits = levels.groupBy("d", "p").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit)
    return (
        levels.select("cell", "d", "p")
        .join(fits.select("d", "p"), ["d", "p"])
        .groupBy("cell")
        .agg(F.min("d").alias("depth"))
        .join(cells.select("cell"), "cell", "right")
    )


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages: rows of a bucket that can't split, by running bytes, with no bucket in one task.

    Rows are dealt to chunks by a hash of their content and place in the input; a chunk's pages are its own.
    """
    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    dealt = rows.join(counts, "h").withColumn("chunk", F.expr(f"pmod(xxhash64(row), n div {CHUNK} + 1)"))
    dealt = dealt.withColumn("large", F.col("n_bytes") * 2 > limit)
    order = Window.partitionBy("h", "chunk", "large").orderBy("n_bytes", "doc_id", "row")
    # a small row starts in the half of a page before which its running sum lies, so it ends in that page
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = F.floor(before / max(1, limit - limit // 2)).cast("string")
    own = F.concat(F.lit("own"), F.row_number().over(order).cast("string"))
    page = F.when(F.col("large"), own).otherwise(small)
    return dealt.withColumn("page", F.concat_ws(".", F.col("chunk").cast("string"), page)).drop("n", "chunk", "large")


def assign_shards(
    docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: doc_id, n_bytes, depth (hash bits of its shard), shard (string)."""
    return _assign(docs, limit_bytes, id_col, text_col, F.monotonically_increasing_id()).drop("row")


def _assign(docs: DataFrame, limit_bytes: int, id_col: str, text_col: str, row: Column) -> DataFrame:
    """The assignment with one more column, the number of the row."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10)
            .cast("long")
            .alias("h"),
            row.alias("row"),
        )
    )
    done: list[DataFrame] = []
    start = 0
    while True:
        n, total, low, high = rows.agg(F.count("*"), F.sum("n_bytes"), F.min("h"), F.max("h")).first()
        if not n:
            break
        if low == high or start >= BITS:  # one hash value, or no bits left
            if total <= limit_bytes:
                done.append(rows.withColumn("depth", F.lit(start)).withColumn("page", F.lit(None).cast("string")))
            else:
                done.append(_pages(rows, limit_bytes).withColumn("depth", F.lit(BITS)))
            break
        depth = min(BITS, start + max(1, math.ceil(math.log2(max(1, total / limit_bytes)))) + EXTRA_BITS)
        found = rows.withColumn("cell", _prefix(depth)).join(_round(rows, start, depth, limit_bytes), "cell").drop("cell")
        found = cut(found)
        done.append(found.where("depth is not null").withColumn("page", F.lit(None).cast("string")))
        rows, start = found.where("depth is null").drop("depth"), depth + 1
        if depth == BITS:
            start = BITS
    columns = ["doc_id", "row", "n_bytes", "h", "depth", "page"]
    if not done:
        done = [rows.withColumn("depth", F.lit(0)).withColumn("page", F.lit(None).cast("string"))]
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.unionByName(more.select(*columns))
    name = F.concat_ws(
        "-", F.col("depth").cast("string"), _prefix("depth").cast("string"), F.col("page")
    )
    return out.select("doc_id", "row", "n_bytes", F.col("depth").cast("int").alias("depth"), name.alias("shard"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as Parquet, one folder a shard; returns the assignment.

    The rows are numbered and kept, with their numbers, in the shared folder until they are written, so each
    row goes to its own place, whatever types its columns have and however alike rows are. The folders'
    column is `shard`, with as many underscores in front as no column of the documents has, in any case.
    """
    held = docs.columns
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in held]).alias("held"),
    )
    kept = cut(numbered)
    plan = cut(_assign(kept, limit_bytes, "id", "text", F.col("row")))
    folder = "shard"
    while folder in {c.lower() for c in held}:
        folder = "_" + folder
    columns = [F.col("held").getField(c).alias(c) for c in held]
    placed = kept.join(plan.select("row", "shard"), "row").repartition("shard")
    placed.select(*columns, F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
    return plan.drop("row")
