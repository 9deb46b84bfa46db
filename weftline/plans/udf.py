"""Queries over the user-defined function surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import grouped, states, udfs
from weftline.plans.base import Catalog, Tables

QUERIES = Catalog()


@QUERIES.add("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1")
def f_pandas_scalar(t: Tables) -> DataFrame:
    priced = t.lineitem.select("l_returnflag", udfs.discounted("l_extendedprice", "l_discount").alias("x"))
    return priced.groupBy("l_returnflag").agg(F.round(F.sum("x"), 2).alias("revenue"))


@QUERIES.add("SELECT c_mktsegment, round(median(c_acctbal), 4) AS mid FROM customer GROUP BY 1")
def f_pandas_aggregate(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(udfs.middle("c_acctbal"), 4).alias("mid"))


@QUERIES.add(
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice) / 1000, 3) AS spread
    FROM lineitem GROUP BY 1"""
)
def f_partial_states(t: Tables) -> DataFrame:
    """Mean and variance by a Python aggregate whose states are merged; no group is whole in one worker."""
    made = {"n": "long", "mean": "double", "squares": "double"}
    found = states.aggregate_states(t.lineitem, ["l_returnflag"], ["l_extendedprice"], made, states.moments, states.merge_moments)
    return found.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round(F.col("squares") / F.col("n") / 1000, 3).alias("spread"))


@QUERIES.add("SELECT n_nationkey, (n_nationkey * 2)::BIGINT AS twice, regexp_replace(n_name, '[^A-Z0-9]', '', 'g') AS short FROM nation")
def f_arrow_and_row(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", udfs.doubled(F.col("n_nationkey").cast("long")).alias("twice"), udfs.initials("n_name").alias("short"))


@QUERIES.add(
    "SELECT event_id, round(median(value) OVER (PARTITION BY user_id), 6) AS mid FROM events"
)
def f_pandas_window(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(udfs.middle("value").over(Window.partitionBy("user_id")), 6).alias("mid"))


@QUERIES.add("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word, length(unnest(string_split(n_name, '_')))::INTEGER AS n FROM nation")
def f_table_function(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    t.spark.udtf.register("word_lengths", udfs.WordLengths)
    return t.spark.sql("SELECT n_nationkey, w.word, w.n FROM nation, LATERAL word_lengths(n_name) w")


@QUERIES.add("SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS y FROM nation")
def f_sql_function(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION square_plus(x INT, c INT) RETURNS INT RETURN x * x + c")
    return t.spark.sql("SELECT n_nationkey, square_plus(n_nationkey, 1) AS y FROM nation")


@QUERIES.add(
    "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders"
)
def f_grouped_map(t: Tables) -> DataFrame:
    """A call gets many customers, all orders of each, since calls and not rows are what costs."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    calls = orders.count() // grouped.ROWS_A_CALL + 1
    call = F.pmod(F.xxhash64("o_custkey"), F.lit(calls)).alias("call")
    return orders.groupBy(call).applyInPandas(grouped.ranked_share, "o_orderkey long, share double")


@QUERIES.add(
    """SELECT coalesce(c_nationkey, s_nationkey)::INTEGER AS k, coalesce(c, 0)::BIGINT AS customers, coalesce(s, 0)::BIGINT AS suppliers FROM
    (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1)
    ON c_nationkey = s_nationkey"""
)
def f_cogrouped_map(t: Tables) -> DataFrame:
    def count(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    return (
        t.customer.select("c_nationkey", "c_custkey").groupBy("c_nationkey")
        .cogroup(t.supplier.select("s_nationkey", "s_suppkey").groupBy("s_nationkey"))
        .applyInPandas(count, "k int, customers long, suppliers long")
    )


@QUERIES.add("SELECT p_partkey, p_retailprice * 2 AS x FROM part WHERE p_size > 25")
def f_map_in_batches(t: Tables) -> DataFrame:
    def run(frames):
        for f in frames:
            f = f[f["p_size"] > 25]
            yield pd.DataFrame({"p_partkey": f["p_partkey"], "x": f["p_retailprice"] * 2})

    return t.part.select("p_partkey", "p_size", "p_retailprice").mapInPandas(run, "p_partkey long, x double")


@QUERIES.add("SELECT p_partkey, p_size FROM part WHERE p_size <= 25")
def f_map_in_arrow(t: Tables) -> DataFrame:
    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield b.filter(pc.less_equal(b.column("p_size"), 25))

    return t.part.select("p_partkey", "p_size").mapInArrow(run, "p_partkey long, p_size int")
