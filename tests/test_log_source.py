"""The Python data source: commits, filters, failed writes and streams."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from weftline.sources import log_source as log

SCHEMA = "k long, s string, x double, b boolean, at timestamp_ntz"
ROWS = [(k, f"s{k % 5}", float(k) if k % 7 else float("nan"), k % 2 == 0, dt.datetime(2024, 1, 1 + k % 20)) for k in range(200)]
ROWS += [(None, None, None, None, None), (500, "", -0.0, True, None)]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for k in (0, 1):
        log.write_log(df.where(F.coalesce(F.col("k"), F.lit(0)) % 2 == k).repartition(2), f"{tmp_path}/t")
    return f"{tmp_path}/t", df


FILTERS = [
    "k >= 150", "k = 3", "k < 5 AND s = 's1'", "x > 100", "b", "s IN ('s1', '')", "s IS NULL", "NOT k = 3", "at < timestamp_ntz'2024-01-05'",
    "k IS NOT NULL AND x IS NULL", "k = -1", "s LIKE 's1%'", "k <=> null", "k > 10 OR b",
]


@pytest.mark.parametrize("where", FILTERS)
def test_filters_give_what_spark_gives(spark, table, where):
    path, df = table
    got = log.read_log(spark, path, df.schema).where(where)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where(where).collect()))


def test_the_source_takes_filters_and_leaves_out_files(spark, table):
    path, df = table
    held = log.read_log(spark, path, df.schema).where("k >= 150 AND s = 's1'")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    reader = log.LogReader(path, df.schema)
    from pyspark.sql.datasource import GreaterThan

    assert list(reader.pushFilters([GreaterThan(("k",), 300), GreaterThan(("x",), 1.0)])) == [GreaterThan(("x",), 1.0)]
    assert len(reader.partitions()) == 1 and len(log.LogReader(path, df.schema).partitions()) == 4


def test_a_failed_task_leaves_no_rows(spark, table):
    path, df = table

    def fail(batches):
        for batch in batches:
            if 77 in batch.column("k").to_pylist():
                raise ValueError("on purpose")
            yield batch

    with pytest.raises(Exception, match="on purpose"):
        log.write_log(df.repartition(4).mapInArrow(fail, df.schema), path)
    assert log.read_log(spark, path, df.schema).count() == len(ROWS)
    time.sleep(1)  # for tasks that are being killed
    log.vacuum(path)
    assert len(os.listdir(f"{path}/{log.FILES}")) == 4 and len(os.listdir(f"{path}/{log.COMMITS}")) == 2


def test_overwriting_and_empty_commits(spark, table, tmp_path):
    path, df = table
    log.write_log(df.where("k < 3"), path, overwrite=True)
    log.write_log(df.where("k = 4"), path)
    assert sorted(r["k"] for r in log.read_log(spark, path, df.schema).collect()) == [0, 1, 2, 4]
    log.write_log(df.limit(0), path, overwrite=True)
    assert log.read_log(spark, path, df.schema).count() == 0
    assert log.read_log(spark, f"{tmp_path}/none", df.schema).count() == 0


def test_commits_are_a_stream(spark, table, tmp_path):
    path, df = table

    def run():
        rows = log.stream_log(spark, path, df.schema)
        writer = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/out").count()

    assert run() == len(ROWS)
    log.write_log(df.where("k < 10"), path)
    assert run() == len(ROWS) + 10 and run() == len(ROWS) + 10
