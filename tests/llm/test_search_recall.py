"""Recall of the search where queries and vectors are unlike each other or uneven."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.ann import search


@pytest.mark.parametrize("case", ["opposite", "rare and long"])
def test_unlike_queries_and_rare_vectors_keep_their_recall(spark, case):
    rng = np.random.default_rng(5)
    n, dims = 6000, 32
    x = rng.normal(size=(12, dims))[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, dims))
    asked = np.arange(0, n, 20)
    if case == "opposite":
        x[asked] *= -1
    else:
        x[7:n:1000] = 50 * rng.normal(size=x[7:n:1000].shape)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in search(df, F.col("vec_id") % 20 == 0, sample_rows=3000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20].tolist()
    assert np.mean([len(got[q] & set(t)) for q, t in zip(asked.tolist(), true, strict=True)]) / 20 >= 0.95
