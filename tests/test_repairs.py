"""Range joins of mixed widths, percentiles of groups without values, databases, fingerprints."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import fingerprints, joins, windows
from weftline.sources import jdbc


@pytest.mark.parametrize("width", [None, 0.5, 1000.0])
def test_range_join_of_mixed_widths_equals_comparing_all(spark, width):
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    points = [rng.choice([rng.uniform(-5, 5), rng.uniform(-1e9, 1e9), float(rng.randint(-3, 3))]) for _ in range(400)] + [None, inf, -inf, nan, 0.0, -0.0, 1e300]
    ranges = [(k, x := rng.choice([rng.uniform(-5, 5), rng.uniform(-1e9, 1e9), 0.0]), x + rng.choice([0.0, 1e-9, 0.1, 3.0, 1e6, 1e12])) for k in range(120)]
    ranges += [(200, None, 1.0), (201, 1.0, None), (202, 3.0, 1.0), (203, -inf, inf), (204, nan, 1.0), (205, -1e300, 1e300)]
    p = spark.createDataFrame([(k, x) for k, x in enumerate(points)], "p long, x double")
    r = spark.createDataFrame(ranges, "r long, lo double, hi double")
    got = {(a["p"], a["r"]) for a in joins.range_join(p, r, "x", "lo", "hi", width).collect()}
    real = [(k, a, b) for k, a, b in ranges if a is not None and b is not None and abs(a) < inf and abs(b) < inf]
    want = {(k, q) for k, x in enumerate(points) if x is not None for q, a, b in real if a <= x <= b}
    assert got == want and len(got) > 500
    # a very wide range is a few rows
    dealt = joins.range_join(p, r.where("r = 205"), "x", "lo", "hi")
    assert dealt.count() == sum(x is not None and abs(x) <= 1e300 for x in points)
    assert joins.range_join(p, r.limit(0), "x", "lo", "hi").count() == joins.range_join(p.limit(0), r, "x", "lo", "hi").count() == 0


def test_percentiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, None), (None, 5.0), (3, 1.0), (3, 4.0)], "k int, v double")
    got = {tuple(r) for r in windows.percentiles(df, ["k"], "v", {"m": ("cont", 0.5), "d": ("disc", 0.5)}).collect()}
    assert got == {(1, 2.0, 2.0), (2, None, None), (None, 5.0, 5.0), (3, 2.5, 1.0)}


def test_the_database_gets_the_filters_and_parts(spark):
    url, driver = jdbc.database(spark)
    # Derby takes no null of text from Spark
    rows = [(k, f"n{k % 3}", k / 2) for k in range(100)] + [(None, "z", None)]
    df = spark.createDataFrame(rows, "k long, s string, x double")
    jdbc.write_jdbc(df, url, "T", "s VARCHAR(10)", driver)
    back = jdbc.read_jdbc(spark, url, "T", "k", jdbc.ends(df, "k"), 4, driver)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    some = back.where("s = 'n1' AND k >= 50").select("x")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(S), *IsNotNull(K), *EqualTo(S,n1), *GreaterThanOrEqual(K,50)]".lower() in plan.lower()
    assert sorted(r["x"] for r in some.collect()) == [k / 2 for k in range(50, 100) if k % 3 == 1]
    assert spark.sparkContext.master.startswith("local[")


def test_fingerprints_put_case_accents_and_punctuation_aside(spark):
    texts = ["Élan vital!", "elan  VITAL", "élan vital", "ｅｌａｎ vital", "élan, vital", "élan vitals", "...", "!!!", "...", "", "", None, None, "Ελλάς", "ελλάς"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "elan vital")], "doc_id long, text string")
    df = df.withColumn("e", F.lit(1)).withColumn("words_md5", F.lit("clash"))
    got = {r["doc_id"]: (r["exact_id"], r["class_id"], r["n_same"]) for r in fingerprints.fingerprints(df).collect()}
    assert [got[k] for k in range(6)] == [(k, 0, 6) for k in range(5)] + [(5, 5, 1)]
    assert [got[k][1:] for k in (6, 7, 8, 9, 10, 11, 12)] == [(6, 2), (7, 1), (6, 2), (9, 2), (9, 2), (None, 0), (None, 0)]
    assert got[13][1] == got[14][1] == 13 and got[8][0] == 6 and got[None] == (None, 0, 6)
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def test_states_of_parts_give_the_whole(spark, monkeypatch):
    from weftline.functions import states

    monkeypatch.setattr(states, "HELD", 3)
    rows = [(k % 7 if k % 11 else None, f"s{k % 2}", float(k * k % 101) if k % 5 else None) for k in range(500)] + [(99, "s0", None)]
    df = spark.createDataFrame(rows, "k long, s string, x double").repartition(6)
    made = {"n": "long", "mean": "double", "squares": "double"}
    got = states.aggregate_states(df, ["k", "s"], ["x"], made, states.moments, states.merge_moments).collect()
    want = df.groupBy("k", "s").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v")).collect()
    as_dict = {(r["k"], r["s"]): r for r in got}
    assert len(got) == len(as_dict) == len(want)
    for r in want:
        mine = as_dict[r["k"], r["s"]]
        assert mine["n"] == r["n"] and (not r["n"] or (mine["mean"] == pytest.approx(r["mean"]) and mine["squares"] / r["n"] == pytest.approx(r["v"])))
    assert states.aggregate_states(df.limit(0), ["k"], ["x"], made, states.moments, states.merge_moments).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_carried_values_and_sessions_of_a_hot_key(spark, parts):
    import datetime as dt

    rng = random.Random(6)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(200_000)) if rng.random() < 0.97 else None for _ in range(900)]
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), t, rng.choice([None, k])) for k, t in enumerate(at)]
    df = spark.createDataFrame(rows, "id int, u string, t timestamp_ntz, v int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        last = {r["id"]: r["last"] for r in windows.carried(df, ["u"], ["t", "id"], F.col("v"), "last").collect()}
        session = {r["id"]: r["session"] for r in windows.sessionize(df, "u", "t", 600, ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for u in ("hot", "b", None):
        value, n, before = None, 0, None
        for k, _, t, v in sorted((r for r in rows if r[1] == u), key=lambda r: (r[2] is None, r[2] or 0, r[0])):
            value = v if v is not None else value
            n += bool(t and before and t - before > dt.timedelta(seconds=600))
            before = t
            assert last[k] == value and session[k] == n


def test_parts_become_batches_of_equal_numbers_of_files(spark, tmp_path):
    from weftline.streaming import events

    df = spark.createDataFrame([(k, k) for k in range(7)], "event_id long, ts long").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    stream = events.event_batches(spark, [df.where("event_id < 1"), df.where("event_id = 99"), df.where("event_id >= 1")])
    seen = []
    writer = stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r["event_id"] for r in b.collect())))
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [s for s in seen if s] == [[0], [1, 2, 3, 4, 5, 6]] and seen[0] == [0]
