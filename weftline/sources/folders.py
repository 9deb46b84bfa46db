"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh place under the folder that the cluster names in spark.checkpoint.dir.

    Where the setting is missing, it lies in a folder of this process if all runs on this machine.
    """
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from that copy, which outlives a lost executor."""
    _root(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder from whatever file system holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", "")
        if not root and context.master.split("[")[0] != "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = root or tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root
