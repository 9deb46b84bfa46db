"""Tables as folders of database files, for executors that share no database."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.sources import jdbc

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
from weftline.sources import read_table
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.local.dir", sys.argv[1]).getOrCreate())
sf = "/root/testdata/sf0.001"
got = __spark_entry__.queries()["io_jdbc"](spark, sf)
assert got.schema.simpleString() == "struct<c_custkey:bigint,c_name:string,c_acctbal:double>"
want = read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_custkey >= 10").select(got.columns)
assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 5
"""


def test_the_database_query_runs_where_executors_are_processes(tmp_path):
    subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], cwd=ROOT, check=True, timeout=240)


def test_database_files_keep_all_values(spark, tmp_path):
    texts = ["a", "", None, " lead", "trail ", 'q"q', '""', "x,y", "li\nne", "cr\r\nlf\r", "Ünï😀", "back\\slash", "tab\t", "\x00\x85", "null", "'"]
    rows = [
        (k if k % 9 else None, s, s, k % 2 == 0 if k % 5 else None, k / 7 * 10.0 ** (k - 20) if k % 4 else None, dt.date(1900 + k, 2, 3), Decimal(k) / 100)
        for k, s in enumerate(texts * 3)
    ]
    df = spark.createDataFrame(rows, 'k long, s string, `t "x"` string, b boolean, x double, d date, p decimal(12,2)')
    urls = jdbc.write_files(df, f"file:{tmp_path}/t", "s VARCHAR(20)", rows=7)
    assert len(urls) == 7
    back = jdbc.read_files(spark, urls)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    some = back.where("s = 'x,y' AND k > 10").select("k")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("JDBCRelation") == 7 and "EqualTo(s,x,y)" in plan and "GreaterThan(k,10)" in plan
    assert sorted(r["k"] for r in some.collect()) == [23, 39]


def test_database_files_of_no_rows_and_of_types_without_a_column(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.lit("a"))
    none = jdbc.read_files(spark, jdbc.write_files(df.limit(0), str(tmp_path / "none")))
    assert none.columns == ["id", "s"] and none.count() == 0
    with pytest.raises(ValueError, match="column a"):
        jdbc.write_files(df.select(F.array("id").alias("a")), str(tmp_path / "array"))
