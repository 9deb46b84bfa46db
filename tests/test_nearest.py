"""Exact nearest neighbours against comparing all."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import nearest


def dot(x, y):  # one product after the other; sum() would compensate
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def plain(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors[i] = min(vectors.get(i, v), v, key=lambda w: np.asarray(w, np.float64).tobytes())
    out = []
    for q, x in vectors.items():
        if q % every == 0:
            scored = sorted((-dot(x, y), i) for i, y in vectors.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(kind, rng):
    if kind == "clusters":
        centres = rng.normal(size=(8, 5)) * 10
        made = [(i, (centres[i % 8] + rng.normal(size=5) * 0.1).astype(np.float32).tolist()) for i in range(700)]
    elif kind == "norms":
        made = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(-3, 3)).astype(np.float32).tolist()) for i in range(500)]
    else:  # a third are one vector, the others have few values
        made = [(i, [1.0, 2.0, 0.0, 0.0, 1.0] if i % 3 == 0 else rng.integers(-1, 2, 5).astype(float).tolist()) for i in range(600)]
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [inf, 0.0, 0.0, 0.0, 1.0], [nan, 1.0, 1.0, 1.0, 1.0]]
    made += [(1000 + 20 * k, v) for k, v in enumerate(odd)] + [(None, [1.0] * 5), made[20], made[21], (40, [3.0, -1.0, 0.5, 0.0, 0.0])]
    return made


@pytest.mark.parametrize("kind", ["clusters", "norms", "ties"])
def test_equals_comparing_all(spark, kind, monkeypatch):
    monkeypatch.setattr(nearest, "PER_CELL", 40)
    monkeypatch.setattr(nearest, "BLOCK", 30)
    rows = rows_of(kind, np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("cell", F.lit("x"))
    got = sorted(tuple(r) for r in nearest.exact_nearest(df.repartition(3), F.col("vec_id") % 20 == 0, 7).collect())
    assert got == plain(rows, 7, 20) and len(got) > 150


def test_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    query = F.col("vec_id") % 20 == 0
    assert sorted(tuple(r) for r in nearest.exact_nearest(df, query, 5).collect()) == plain(rows, 5, 20)
    assert nearest.exact_nearest(df.limit(0), query).count() == 0
    assert nearest.exact_nearest(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_skip_cells():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 10
    figures = {"n": np.full(20, 5.0), "far": np.full(20, 0.5), "norm": np.sqrt((centres**2).sum(1)) + 0.5}
    import pyarrow as pa

    class Frame:  # runs the function that _visits hands to Spark
        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    q = centres[:3]
    least = np.sqrt((q**2).sum(1)) * (np.sqrt((q**2).sum(1)) - 1)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([x.tobytes() for x in q]), pa.array(least)], names=["id", "v", "least"])
    visits = {later: next(iter(nearest._visits(Frame(), centres, figures, later).run([batch]))).to_pydict() for later in (False, True)}
    assert len(visits[False]["id"]) == 3 * nearest.FIRST
    seen = {(i, c) for v in visits.values() for i, c in zip(v["id"], v["cell"], strict=True)}
    assert len(seen) < 15 and all((k, k) in seen for k in range(3))
