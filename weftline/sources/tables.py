"""Named parquet tables under one directory, local or in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it: filters and column choices made later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
