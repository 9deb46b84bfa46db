"""Lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.folders import cut

HOT = 10_000  #: a line with more than one in so many of all occurrences is looked up without a shuffle


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _name(line: Column) -> Column:
    """A line's hashes, of 96 bits together; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h"), F.hash(bare, F.lit(1)).alias("c")))


def remove_repeated_lines(docs: DataFrame, least: int = 5, text_col: str = "text") -> DataFrame:
    """The documents without lines that `least` or more of them hold, with n_lines and n_removed.

    A line counts once for a document, without blanks around it, and blank lines count and go nowhere.
    What is left keeps its order. Lines are counted in the tasks first, so a line that every document has
    is one row a task. The counts are then the sketch of what is frequent: lines with more than one in HOT
    of all occurrences, so at most HOT lines, are sent to the executors, and only the others are joined by
    line, none of which can fill a task. Documents get the places of their repeated lines by the hashes
    of their text, so equal texts share one entry.

    Cases: a null text is one blank line and stays null; repeated rows are documents of their own and
    keep a row each; other columns stay as they are, whatever their names; an empty table stays empty.
    """
    key = [F.xxhash64(text_col).alias("_t1"), F.hash(text_col, F.lit(1)).alias("_t2")]
    counted = docs.select(F.explode(F.array_distinct(F.transform(_lines(text_col), _name))).alias("_n")).where("_n is not null")
    counts = cut(counted.groupBy("_n.h", "_n.c").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    every = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > every / HOT
    placed = docs.select(*key, F.posexplode(F.transform(_lines(text_col), _name)).alias("_place", "_n")).where("_n is not null")
    placed = placed.select("_t1", "_t2", "_place", "_n.h", "_n.c")
    hot = F.broadcast(counts.where(frequent).select("h", "c", F.lit(True).alias("_hot")))
    placed = placed.join(hot, ["h", "c"], "left")
    rest = placed.where("_hot is null").join(counts.where(~frequent).select("h", "c"), ["h", "c"], "left_semi")
    repeated = placed.where("_hot").select("_t1", "_t2", "_place").unionByName(rest.select("_t1", "_t2", "_place"))
    gone = cut(repeated.groupBy("_t1", "_t2").agg(F.collect_set("_place").alias("_gone")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key, _lines(text_col).alias("_lines"))
    found = own.join(gone, ["_t1", "_t2"], "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_row")[text_col].isNotNull(), kept)
    columns = [(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns]
    return found.select(*columns, F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))
