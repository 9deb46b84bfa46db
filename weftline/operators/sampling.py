"""Samples that every engine repeats: what is drawn depends on ids and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64  #: parts of a stratum that are cut down by themselves


def uniform(id_col: str, seed: int) -> Column:
    """A number above 0 and below 1 from the md5 of an id and a seed; null ids have that of an empty text."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, by: list[str], id_col: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum, drawn by weight without replacement, with their place in the draw (from 1).

    A row's key is an exponential variable with the weight as its rate; the n smallest keys of a stratum
    are a weighted sample without replacement, and the first of them is drawn with a chance in proportion
    to its weight. A stratum is cut to n rows in parts, and before each shuffle in each task, so no task
    sorts a stratum that holds a large part of all rows; what meets is SALTS times n rows at most.

    Cases: rows without a weight above 0 are never drawn; a stratum of fewer rows gives all; null is a
    stratum of its own; rows of one id have one key, the heavier one first; repeated rows are drawn as
    often as they occur.
    """
    rate = F.col(weight).cast("double")
    kept = df.where((rate > 0) & (rate < float("inf"))).withColumn("_key", -F.log(uniform(id_col, seed)) / rate)
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(SALTS)))
    for keys in ([*by, "_salt"], by):
        order = Window.partitionBy(*keys).orderBy("_key", F.col(id_col).asc_nulls_first())
        kept = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return kept.drop("_key", "_salt")
