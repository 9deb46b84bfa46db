"""Every query outside llm against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
RUNS, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(dicts: list[dict]) -> list[tuple]:
    return sorted(tuple((k, str(r[k])) for k in sorted(r)) for r in dicts)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_its_twin(spark, duck, name):
    ours = RUNS[name](spark, SF).toArrow()
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(ours.column_names) == sorted(names)
    assert rows(ours.to_pylist()) == rows(theirs)


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
