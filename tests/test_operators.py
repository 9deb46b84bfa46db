"""Operators on small frames with nulls, ties and empty sides."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import aggregates, joins, windows

T = dt.datetime(2024, 1, 1)


def hours(n):
    return T + dt.timedelta(hours=n)


def test_asof_join_carries_over_buckets_and_keeps_nulls(spark):
    left = spark.createDataFrame(
        [(1, "a", hours(0)), (2, "a", hours(30)), (3, "a", hours(100)), (4, "b", hours(1)), (5, None, hours(1)), (6, "a", None)],
        "id int, k string, t timestamp_ntz",
    )
    right = spark.createDataFrame([("a", hours(1), 10), ("a", hours(30), 11), ("a", None, 12), (None, hours(0), 13)], "k string, t timestamp_ntz, v int")
    got = {r["id"]: r["r_v"] for r in joins.asof_join(left, right, "k", "t").collect()}
    assert got == {1: None, 2: 11, 3: 11, 4: None, 5: None, 6: None}
    assert joins.asof_join(left, right.limit(0), "k", "t").where("r_v is not null").count() == 0
    assert joins.asof_join(left.limit(0), right, "k", "t").count() == 0


def test_range_join_equals_comparing_all(spark):
    points = spark.range(200).select((F.col("id") * 1.7).alias("x"))
    ranges = spark.range(40).select(F.col("id").alias("r"), (F.col("id") * 7.0).alias("lo"), (F.col("id") * 7.0 + F.col("id") % 5).alias("hi"))
    got = {(r["x"], r["r"]) for r in joins.range_join(points, ranges, "x", "lo", "hi", 3).collect()}
    want = {(r["x"], r["r"]) for r in points.join(ranges, F.col("x").between(F.col("lo"), F.col("hi"))).collect()}
    assert got == want


def test_salted_forms_equal_plain_ones(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, name string")
    assert joins.salted_join(big, small, "k", 4).count() == big.join(small, "k").count()
    got = {r["k"]: r["n_distinct"] for r in aggregates.salted_aggregate(big, ["k"], "id", 4).collect()}
    assert got == {0: 334, 1: 333, 2: 333}


def test_sessions_start_after_gaps(spark):
    df = spark.createDataFrame([(1, "u", hours(0)), (2, "u", hours(1)), (3, "u", hours(5)), (4, "v", hours(0))], "i int, u string, t timestamp_ntz")
    got = {r["i"]: r["session"] for r in windows.sessionize(df, "u", "t", 2 * 3600, ["i"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_frames_in_chunks_equal_plain_windows(spark):
    rows = [(i, "a" if i % 5 else None, i * 7 % 101, (i * 13 % 17) if i % 6 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, t int, v int").repartition(4)
    near = windows.rows_frame(df, ["k"], ["t", "i"], lambda frame: F.sum("v").over(frame), 3, 2, "near", chunk=7)
    plain = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "i").rowsBetween(-3, 2)
    want = {(r["i"], r["x"]) for r in df.select("i", F.sum("v").over(plain).alias("x")).collect()}
    assert {(r["i"], r["near"]) for r in near.collect()} == want
    assert windows.rows_frame(df.limit(0), ["k"], ["t", "i"], lambda frame: F.sum("v").over(frame), 3, 2, "near").count() == 0


def test_percentiles_by_places_equal_the_functions(spark):
    rows = [(i % 3 if i % 10 else None, float(i * 37 % 211) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    wanted = {"m": ("cont", 0.5), "q": ("cont", 0.9), "d": ("disc", 0.25), "top": ("disc", 1.0), "low": ("cont", 0.0)}
    got = {tuple(r) for r in windows.percentiles(df, ["k"], "v", wanted).select("k", *wanted).collect()}
    kinds = {"cont": "percentile_cont", "disc": "percentile_disc"}
    made = [F.expr(f"{kinds[a]}({b}) WITHIN GROUP (ORDER BY v)").alias(n) for n, (a, b) in wanted.items()]
    want = {tuple(r) for r in df.groupBy("k").agg(*made).collect()}
    near = lambda rows: sorted([tuple(-1 if x is None else round(x, 6) for x in r) for r in rows])
    assert near(got) == near(want)


def test_groups_frame_counts_peers(spark):
    rows = [("a", 1, 10), ("a", 1, 1), ("a", 2, 100), ("a", 4, 1000), (None, 1, 5), ("a", None, 7)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r["k"], r["t"], r["v"], r["near"]) for r in windows.groups_frame_sum(df, ["k"], "t", "v", 1, 1, "near").collect()}
    assert got == {("a", 1, 10, 111), ("a", 1, 1, 111), ("a", 2, 100, 1111), ("a", 4, 1000, 1107), (None, 1, 5, 5), ("a", None, 7, 1007)}


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 15").select("l_orderkey", "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,15.0)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan
