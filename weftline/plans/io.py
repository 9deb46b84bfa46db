"""Sources and sinks: what is written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.base import Catalog, Tables
from weftline.sources import formats, jdbc, log_source
from weftline.sources.folders import cut, delete_folder, shared_folder

QUERIES = Catalog()

for _kind in ("parquet", "orc", "json", "csv", "xml"):

    def _round_trip(t: Tables, kind: str = _kind) -> DataFrame:
        rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        return formats.round_trip(rows, kind, shared_folder(t.spark, kind))

    QUERIES.add("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", f"io_{_kind}")(_round_trip)


@QUERIES.add("SELECT n_name AS value FROM nation")
def io_text(t: Tables) -> DataFrame:
    return formats.round_trip(t.nation.select(F.col("n_name").alias("value")), "text", shared_folder(t.spark, "text"))


@QUERIES.add("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def io_partitioned(t: Tables) -> DataFrame:
    """Folders by status; the filter reads one folder only."""
    path = shared_folder(t.spark, "partitioned")
    formats.write(t.orders.repartition("o_orderstatus"), "parquet", path, by=["o_orderstatus"])
    rows = t.spark.read.schema(t.orders.schema).parquet(path).where("o_orderstatus = 'F'")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@QUERIES.add("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def io_bucketed_join(t: Tables) -> DataFrame:
    """Two tables with buckets of the join key: the join reads them without a shuffle."""
    keyed = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    run = uuid.uuid4().hex
    made = []
    try:
        for rows, name in ((keyed, "orders"), (t.customer, "customers")):
            path, table = shared_folder(t.spark, name), f"weftline_{name}_{run}"
            made.append((path, table))
            formats.bucketed(rows, table, 8, "c_custkey", path)
        orders, customers = (t.spark.table(table) for _, table in made)
        joined = customers.hint("merge").join(orders, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
        return cut(joined)  # a row a segment, so that the tables can go
    finally:
        for path, table in made:
            t.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_folder(t.spark, path)


@QUERIES.add("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND event_id >= 100 AND value > 0.5")
def io_python_source(t: Tables) -> DataFrame:
    """Events through a Python source: two commits, read back with the filters that the source takes."""
    path = shared_folder(t.spark, "log")
    for k in (0, 1):
        log_source.write_log(t.events.where(F.col("event_id") % 2 == k), path)
    rows = log_source.read_log(t.spark, path, t.events.schema)
    return rows.where("event_type = 'click' AND event_id >= 100 AND value > 0.5").select("event_id", "user_id", "value")


@QUERIES.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_custkey >= 10")
def io_jdbc(t: Tables) -> DataFrame:
    """Customers written to a database and read back in parts, with the filters in the database.

    Where executors share no database, each part is a database file.
    """
    types = "c_name VARCHAR(100), c_mktsegment VARCHAR(20)"
    if jdbc.has_database(t.spark):
        url, driver = jdbc.database(t.spark)
        table = f"customer_{uuid.uuid4().hex}"
        jdbc.write_jdbc(t.customer, url, table, types, driver)
        rows = jdbc.read_jdbc(t.spark, url, table, "c_custkey", jdbc.ends(t.customer, "c_custkey"), 4, driver)
    else:
        rows = jdbc.read_files(t.spark, jdbc.write_files(t.customer, shared_folder(t.spark, "jdbc"), types))
    return rows.where("c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_custkey >= 10").select("c_custkey", "c_name", "c_acctbal")
