"""Which documents hold passages of which items: an inverted index of word n-grams with positions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.folders import cut

#: A word is a run of letters, digits and characters beyond ASCII, in lower case.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

BROADCAST_PLACES = 1_000_000  #: an index of at most so many places is sent to all executors; a larger one is joined
STOCK = 20  #: an n-gram that more items hold is a stock phrase


def words(text: str) -> Column:
    """The words of a column, each by its hash of 64 bits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda x: F.xxhash64(x))


def _grams(n: int) -> Column:
    """The n-grams of a column `w` of words: a hash of the words in order, and one of the words in any order.

    N-grams are told apart by both, so only n-grams of the same words need the first to differ.
    """

    def gram(i: Column) -> Column:
        own = [F.get("w", i + k) for k in range(n)]
        return F.struct(F.xxhash64(*own).alias("gram"), functools.reduce(lambda a, b: a.bitwiseXOR(b), own).alias("check"))

    # sequence() counts down where there are fewer than n words
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), gram))


def item_index(items: DataFrame, id_col: str, text_col: str, n: int, stock: int) -> tuple[DataFrame, DataFrame]:
    """The inverted index and the places of stock phrases.

    Index: gram, check, places (item, version, item_words, at), which are null for a stock phrase; so no
    list holds more than `stock` items. Places of stock phrases: gram, check, item, version, item_words, at.
    """
    named = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(text_col).alias("w")).distinct()
    named = named.select("item", F.xxhash64("w").alias("version"), F.size("w").alias("item_words"), "w")
    held = named.select("item", "version", "item_words", F.posexplode(_grams(n)).alias("at", "g")).select("*", "g.*").drop("g")
    common = held.groupBy("gram", "check").agg(F.count_distinct("item").alias("n_items"))
    common = cut(common.where(F.col("n_items") > stock).select("gram", "check"))
    places = F.collect_list(F.struct("item", "version", "item_words", "at")).alias("places")
    rare = held.join(common, ["gram", "check"], "left_anti").groupBy("gram", "check").agg(places)
    index = rare.unionByName(common.withColumn("places", F.lit(None).cast(rare.schema["places"].dataType)))
    return index, held.join(common, ["gram", "check"])


def overlap(
    docs: DataFrame,
    items: DataFrame,
    n: int = 8,
    stock: int = STOCK,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_places: int = BROADCAST_PLACES,
) -> DataFrame:
    """A row for each document and item that share a run of n words: doc_id, item_id, item_words, covered_words, longest_passage.

    covered_words are the item's words that lie in a shared n-gram; the longest passage is the longest
    stretch of the document's words that the item has in the same order without a gap. N-grams that more
    than `stock` items hold are stock phrases: they have no list in the index and do not pair a document with an item, but count for
    pairs that share another n-gram too.

    The documents' n-grams are looked up in the items' index where they are made, if the index is small
    enough to be sent; else both are joined by n-gram, in which Spark splits what a frequent phrase makes
    large. What goes on is hits, by document and item, so a phrase of a third of all texts is as many
    groups as there are texts. Hits on one diagonal (place in the document less place in the item) without
    a gap are chained into a passage.

    Cases: null texts have no words; texts and items of fewer than n words share nothing; rows of one id
    with the same words are one, with other words rows of their own; documents without an id are listed,
    items without one are not; other columns don't matter.
    """
    index, stock_places = item_index(items, item_id, item_text, n, stock)
    held = docs.select(F.col(doc_id).alias("doc"), words(doc_text).alias("w")).where(F.size("w") >= n)
    grams = held.select("doc", F.xxhash64("w").alias("text"), F.posexplode(_grams(n)).alias("place", "g"))
    grams = grams.select("doc", "text", "place", "g.gram", "g.check")
    index = cut(index)
    size = index.agg(F.sum(F.greatest(F.size("places"), F.lit(1)))).first()[0] or 0
    found = grams.join(F.broadcast(index) if size <= broadcast_places else index, ["gram", "check"])
    found = cut(found.select("doc", "text", "place", "gram", "check", "places"))
    pair = ["doc", "text", "item", "version"]
    columns = [*pair, "item_words", "place", "at"]
    hits = found.where("places is not null").select("doc", "text", "place", F.explode("places").alias("p")).select("doc", "text", "place", "p.*")
    # stock phrases of documents that are paired already, with those of the items that they are paired with
    common = found.where("places is null").select(F.col("doc").alias("doc2"), F.col("text").alias("text2"), "place", "gram", "check")
    same = F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("text") == F.col("text2"))
    paired = hits.select(*pair).distinct().join(common, same).drop("doc2", "text2")
    hits = hits.select(*columns).unionByName(paired.join(stock_places, ["item", "version", "gram", "check"]).select(*columns))
    # all that follows keeps to this dealing: by document and item
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at")).repartition(*[F.col(c) for c in pair])
    hits = hits.select(*pair, "item_words", "diagonal", "at").distinct()
    in_order = Window.partitionBy(*pair, "diagonal").orderBy("at")
    chained = hits.withColumn("passage", F.col("at") - F.row_number().over(in_order))
    passages = chained.groupBy(*pair, "item_words", "diagonal", "passage").agg(F.count("*").alias("length"), F.min("at").alias("first"))
    # passages of a pair as stretches of the item, by their starts; what an earlier one covers counts once
    stretch = Window.partitionBy(*pair).orderBy("first", F.desc("length"), "diagonal")
    end = F.col("first") + F.col("length") + (n - 1)
    before = F.coalesce(F.max(end).over(stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = passages.withColumn("covered", F.greatest(F.lit(0), end - F.greatest(F.col("first"), before)))
    found = covered.groupBy(*pair, "item_words").agg(
        F.sum("covered").cast("long").alias("covered_words"),
        (F.max("length") + (n - 1)).cast("long").alias("longest_passage"),
    )
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("item_words").cast("long").alias("item_words"), "covered_words", "longest_passage"
    )
