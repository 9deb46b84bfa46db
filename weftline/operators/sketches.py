"""Sketches that are kept for each day and merged over windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12  #: HLL of 4096 registers: a standard error of 1.04 / 64
HLL_ERROR = 3 * 1.04 / 64  #: three standard errors of a distinct count
KLL_K = 200
KLL_ERROR = 0.033  #: of a rank, at k = 200: twice the normalized rank error of 99 in 100 single queries


def daily(df: DataFrame, day: str, key: str, value: str) -> DataFrame:
    """day, users (an HLL sketch of key), spread (a KLL sketch of value): a row a day, to be kept and merged later.

    Sketches are built in the tasks and merged, so a day of very many rows is no task of its own. Nulls
    enter neither; a day without values has null sketches.
    """
    return df.groupBy(F.col(day).alias("day")).agg(
        F.hll_sketch_agg(key, LG_K).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("spread")
    )


def merged(sketches: DataFrame, days: int) -> DataFrame:
    """day, users, values, median: estimates over the days up to each day, from kept sketches (day, users, spread)."""
    ends = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("ahead")
    spread = sketches.select("day", "users", "spread", ends).withColumn("end", F.date_add("day", F.col("ahead")))
    held = spread.join(sketches.select(F.col("day").alias("end")), "end", "left_semi")
    both = held.groupBy("end").agg(F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"))
    return both.select(
        F.col("end").alias("day"),
        F.hll_sketch_estimate("users").alias("users"),
        F.kll_sketch_get_n_double("spread").alias("values"),
        F.kll_sketch_get_quantile_double("spread", F.lit(0.5).cast("double")).alias("median"),
    )
