"""Aggregations beyond plain groupBy().agg()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group a map from each value to its count; values are counted before a group's map is built."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def salted_aggregate(df: DataFrame, by: list[str], distinct: str, salts: int) -> DataFrame:
    """count(DISTINCT distinct) per group in two steps, so that no group's values meet in one task."""
    part = F.pmod(F.xxhash64(distinct), F.lit(salts)).alias("_salt")
    per_salt = df.groupBy(*by, part).agg(F.count_distinct(distinct).alias("n"))
    return per_salt.groupBy(*by).agg(F.sum("n").alias("n_distinct"))


def unpivot(df: DataFrame, ids: list[str], values: list[str], kind: str = "double") -> DataFrame:
    """Rows (ids, name, value) for each of the value columns, all cast to one type."""
    cast = df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in values])
    return cast.unpivot(ids, values, "name", "value")
