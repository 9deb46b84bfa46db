"""Joins whose tasks don't grow with their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import joins


def test_a_full_bin_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 1000, raising=False)
    points = spark.range(400).select(F.col("id").alias("p"), (F.col("id") % 40 / 40).alias("x"))
    ranges = spark.range(100).select(F.col("id").alias("r"), F.lit(0.0).alias("lo"), F.lit(1.5).alias("hi"))
    met = joins.range_join(points, ranges, "x", "lo", "hi")
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == met.distinct().count() == 40_000 and max(tasks) < 10_000


def test_a_salted_join_has_tasks_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 100, raising=False)
    large, small = spark.range(1000).select((F.col("id") % 7).alias("k"), "id"), spark.range(5).withColumnRenamed("id", "k")
    met = joins.salted_join(large, small, "k", 4)
    assert met.rdd.getNumPartitions() >= 11 and met.count() == sum(k % 7 < 5 for k in range(1000))
