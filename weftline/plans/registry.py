"""All queries outside the llm subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from weftline.plans import io, relational, scalar, streams, text, udf

    return [relational, scalar, udf, io, streams, text]


def queries() -> dict[str, Query]:
    return {name: run for module in _modules() for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, (_, sql) in module.QUERIES.items() if sql}
