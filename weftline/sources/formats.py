"""File formats as sources and sinks, with schemas stated and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Options under which a format gives back what was written.
OPTIONS = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "escape": '"', "nullValue": "\\N", "emptyValue": ""},
    # a task reads an XML file whole, so files have a bound
    "xml": {"rowTag": "row", "rootTag": "rows", "maxRecordsPerFile": "100000"},
    "text": {},
}


def write(df: DataFrame, kind: str, path: str, by: list[str] | None = None) -> None:
    """Write as many files as the frame has partitions, in folders by the `by` columns if given."""
    writer = df.write.format(kind).options(**OPTIONS[kind])
    (writer.partitionBy(*by) if by else writer).save(path)


def read(spark: SparkSession, kind: str, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.format(kind).options(**OPTIONS[kind]).schema(schema).load(path)


def round_trip(df: DataFrame, kind: str, path: str) -> DataFrame:
    """What a format gives back of a frame."""
    write(df, kind, path)
    return read(df.sparkSession, kind, path, df.schema)


def bucketed(df: DataFrame, table: str, buckets: int, by: str, path: str) -> DataFrame:
    """Save as a new table whose rows lie in buckets of the key, so that joins and groupings on it need no shuffle."""
    spark = df.sparkSession
    df.write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return spark.table(table)
