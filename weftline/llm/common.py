"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's checkpoint folder and go on from that copy.

    The folder is the one that the session names in spark.checkpoint.dir, which all executors
    share, so a lost executor costs nothing that was computed before. Spark deletes a checkpoint when
    nothing refers to it any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_columns(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list]],
    schema: str | StructType,
    rows_at_once: int = 2000,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply fn to the columns (as Python lists) of a few rows at a time; fn may return any number of rows.

    done is called at the end of each partition.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows_at_once):
                    out = fn(batch.slice(at, rows_at_once).to_pydict())
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            if done:
                done()

    return df.mapInArrow(run, fields)


def vocabulary(path: str) -> str:
    """The place of a vocabulary file on this machine: a path is one, a bare name is that of a public vocabulary."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def _folder(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is named, a folder of this process if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A place for a table that lives as long as an operator runs."""
    return f"{_folder(spark)}/{name}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table from whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
