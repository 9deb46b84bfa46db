"""Joins that Spark has no operator for, as compositions of DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS_A_TASK = 20_000_000  #: pairs of a point and a range of its bin that a task compares, about
ROWS_A_TASK = 250_000  #: rows of a salted join's large side that a task sorts, about


def asof_join(
    left: DataFrame, right: DataFrame, by: str, time: str, bucket_seconds: int = 86_400, prefix: str = "r_"
) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time (null columns if none).

    Both sides are laid in one sequence and a window carries the last right row forward. The
    sequence of a key is cut into buckets of time, so a key with very many rows is many tasks; a
    row before the first right row of its bucket gets the last one of the earlier buckets, which
    a window over one row a bucket provides. Of right rows with the same key and time, the one
    with the largest columns counts. Left rows with a null key or time match nothing.
    """
    columns = [c for c in right.columns if c != by]
    kept = F.struct(*[F.col(c) for c in [time, *[c for c in columns if c != time]]])
    mine = F.struct(*[F.col(c) for c in left.columns])
    bucket = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / (bucket_seconds * 1_000_000))
    rows = (
        left.select(F.col(by).alias("k"), F.col(time).alias("t"), mine.alias("l"), F.lit(None).cast(_type(right, kept)).alias("r"))
        .unionByName(
            right.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(
                F.col(by).alias("k"), F.col(time).alias("t"), F.lit(None).cast(_type(left, mine)).alias("l"), kept.alias("r")
            )
        )
        .withColumn("b", bucket)
    )
    # right rows first among equals, so that "at or before" includes the same time
    order = Window.partitionBy("k", "b").orderBy("t", F.col("l").isNotNull(), F.col("r").asc_nulls_last())
    rows = rows.withColumn("near", F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = rows.where("r is not null").groupBy("k", "b").agg(F.max("r").alias("r"))
    buckets = rows.select("k", "b").distinct().join(lasts, ["k", "b"], "left")
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("carried", F.last("r", ignorenulls=True).over(earlier)).select(
        F.col("k").alias("k2"), F.col("b").alias("b2"), "carried"
    )
    matched = rows.where("l is not null").join(
        carried, (F.col("k") == F.col("k2")) & (F.col("b") == F.col("b2")), "left"
    )
    found = F.coalesce("near", "carried")
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    return matched.select(
        *[F.col("l")[c].alias(c) for c in left.columns],
        *[F.when(known, found[c]).alias(f"{prefix}{c}") for c in columns],
    )


def _type(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Point rows with every range row that has low <= at <= high.

    Bins have sizes that are powers of two, and a range is dealt to bins of about its own width, of which
    it meets three at most, so one very wide range is three rows. A point falls into one bin of each size
    that ranges have (a short list, which the driver looks up), and size and bin are an equality
    condition; without them Spark compares all pairs. width: no bins below this size, for fewer sizes.

    Rows with a null, NaN or infinite end match nothing here, nor do points of such values.
    """

    def level_of(size: Column) -> Column:
        return F.floor(F.log2(size)).cast("int")

    a, b = F.col(low).cast("double"), F.col(high).cast("double")
    real = F.lit(float("inf"))
    kept = ranges.where((F.col(low) <= F.col(high)) & (F.abs(a) < real) & (F.abs(b) < real))
    # a size far below the numbers themselves would have bins beyond a whole number
    least = F.greatest(level_of(F.greatest(F.abs(a), F.abs(b), F.lit(1e-300))) - 40, F.lit(-1000))
    if width:
        least = F.greatest(least, F.lit(math.floor(math.log2(width))))
    sized = kept.withColumn("_level", F.greatest(least, F.when(b > a, level_of(b - a)).otherwise(least)))
    scale = F.pow(F.lit(2.0), F.col("_level"))
    binned = sized.withColumn("_bin", F.explode(F.sequence(F.floor(a / scale), F.floor(b / scale))))
    levels = sorted(r["_level"] for r in sized.select("_level").distinct().collect())  # at most some 2000
    place = F.col(at).cast("double")
    spread = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    inside = spread.where(F.abs(place) / F.pow(F.lit(2.0), F.col("_level")) < 2.0**62)
    placed = inside.withColumn("_bin", F.floor(place / F.pow(F.lit(2.0), F.col("_level"))))
    # a bin of many points and many ranges is several tasks, each with a part of its points
    keys = ["_level", "_bin"]
    pairs = placed.groupBy(*keys).agg(F.count("*").cast("double").alias("_p")).join(binned.groupBy(*keys).agg(F.count("*").alias("_r")), keys)
    pairs = pairs.select(*keys, (F.col("_p") * F.col("_r")).alias("_pairs"))
    total = pairs.agg(F.sum("_pairs")).first()[0] or 0.0
    parts = _parts(points, min(20_000, int(total // PAIRS_A_TASK) + 1))
    full = F.broadcast(pairs.where(F.col("_pairs") > PAIRS_A_TASK).select(*keys, F.ceil(F.col("_pairs") / PAIRS_A_TASK).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = placed.join(full, keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("_salts")
    repeated = binned.join(full, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    keys = [*keys, "_salt"]
    return (
        dealt.repartition(parts, *keys)
        .join(repeated.repartition(parts, *keys), keys)
        .where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
        .drop(*keys)
    )


def _parts(df: DataFrame, least: int) -> int:
    """At least so many partitions, and as many as the session shuffles into; an exact number, which Spark doesn't coalesce."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)


def interval_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Rows of one key with left_time <= right_time <= left_time + seconds.

    Time is part of the key in bins of the interval's length, so one key spreads over many tasks.
    The right side's column of the key is dropped.
    """

    def bin_of(column: str) -> Column:
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (seconds * 1_000_000))

    dealt = left.withColumn("_bin", F.explode(F.array(bin_of(left_time), bin_of(left_time) + 1)))
    return (
        dealt.join(right.withColumn("_bin", bin_of(right_time)), [by, "_bin"])
        .where(F.col(right_time).between(F.col(left_time), F.col(left_time) + F.make_interval(secs=F.lit(seconds))))
        .drop("_bin")
    )


def top_per_row(left: DataFrame, right: DataFrame, on: str, order: list[Column], n: int, ties: list[str]) -> DataFrame:
    """Each left row with its first n right rows of the same key (a lateral join).

    The right side is cut to n rows a key before the join. ties: columns that make the order total.
    """
    rank = F.row_number().over(Window.partitionBy(on).orderBy(*order, *ties))
    return left.join(right.withColumn("rank_in_row", rank).where(F.col("rank_in_row") <= n), on)


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int) -> DataFrame:
    """An inner join in which a key of the large side is dealt to `salts` tasks and the small side's rows repeat.

    There are as many tasks as the large side's rows ask for, so what a task sorts doesn't grow with the table.
    """
    parts = _parts(large, large.count() // ROWS_A_TASK + 1)
    dealt = large.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [on, "_salt"]
    return dealt.repartition(parts, *keys).join(repeated.repartition(parts, *keys), keys).drop("_salt")
