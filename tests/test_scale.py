"""Plans and steps that must not grow faster than their input."""

from __future__ import annotations

import __spark_entry__ as entry
import pandas as pd

from weftline.functions import grouped
from weftline.sources import formats

SMALL = "/root/testdata/sf0.001"


def _plan(spark, name: str) -> str:
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_the_latest_view_is_found_without_comparing_all(spark):
    assert "NestedLoop" not in _plan(spark, "j_asof_lateral")


def test_the_latest_order_is_numbered_in_the_order_asked_for(spark):
    windows = [line for line in _plan(spark, "j_lateral_sql").splitlines() if "row_number" in line and "Window " in line]
    assert windows and all("o_orderdate" in line.split("specifiedwindowframe")[0] for line in windows)


def test_a_call_of_the_grouped_map_takes_many_groups():
    rows = pd.DataFrame({"o_custkey": [1, 2, 1, None, None], "o_orderkey": range(5), "o_totalprice": [1.0, 5.0, 3.0, 2.0, 6.0]})
    assert grouped.ranked_share(rows)["share"].tolist() == [0.25, 1.0, 0.75, 0.25, 0.75]


def test_pages_leave_a_task_in_small_batches(spark):
    assert "MapInArrow" in _plan(spark, "x_page_text") and "ArrowEvalPython" not in _plan(spark, "x_page_text")


def test_no_percentile_is_kept_for_every_user(spark):
    keyed = [line for line in _plan(spark, "a_approximate").splitlines() if "Aggregate(key" in line and "percentile" in line]
    assert keyed and not any("user_id" in line.split("functions=")[0] for line in keyed)


def test_xml_files_have_a_bound(spark, tmp_path):
    formats.write(spark.range(250_000).coalesce(1), "xml", f"{tmp_path}/x")
    back = formats.read(spark, "xml", f"{tmp_path}/x", "id long")
    assert len(back.inputFiles()) == 3 and back.count() == 250_000
