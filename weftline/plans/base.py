"""How a plan module states a query and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources import TABLES, read_table

Query = Callable[[SparkSession, str], DataFrame]


class Catalog(dict):
    """QUERIES of a module: name to (query, SQL twin or None)."""

    def add(self, sql: str | None = None, name: str | None = None):
        """Decorator for a function of (tables) or (spark, tables)."""

        def keep(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Tables(spark, sf_dir))

            self[name or fn.__name__] = (run, sql)
            return fn

        return keep

    def same_sql(self, name: str, sql: str, twin: str | None = None) -> None:
        """A query whose Spark SQL is given, with DuckDB's form where it differs."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for table in TABLES:
                if re.search(rf"\b{table}\b", sql):
                    read_table(spark, sf_dir, table).createOrReplaceTempView(table)
            return spark.sql(sql)

        self[name] = (run, twin or sql)


class Tables:
    """Tables as attributes: t.orders is the orders table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
