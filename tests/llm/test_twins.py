"""Queries of this subpackage against their SQL twins in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from weftline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(zip(names, r, strict=True)) for r in cursor.fetchall())
    got = sorted(tuple(r.asDict().items()) for r in QUERIES[name](spark, SF).select(*names).collect())
    assert got == want and set(QUERIES[name](spark, SF).columns) == set(names)
