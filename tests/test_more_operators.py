"""Weighted samples, repeated lines and graphs against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import graphs, lines, sampling

# samples


def test_first_draws_follow_the_weights(spark):
    rows = [(r, f"{r}-{i}", float(i)) for r in range(3000) for i in range(5)]
    df = spark.createDataFrame(rows, "s long, id string, w double")
    got = sampling.weighted_sample(df, ["s"], "id", "w", 2, seed=3).collect()
    assert Counter(r["s"] for r in got) == Counter({r: 2 for r in range(3000)})
    first = Counter(r["w"] for r in got if r["place"] == 1)
    assert first[0.0] == 0 and all(abs(first[float(i)] / 3000 - i / 10) < 0.03 for i in range(1, 5))
    # of the second draws after a first of weight 4, weight 3 is a half
    by = defaultdict(dict)
    for r in got:
        by[r["s"]][r["place"]] = r["w"]
    after = Counter(d[2] for d in by.values() if d[1] == 4.0)
    assert abs(after[3.0] / sum(after.values()) - 0.5) < 0.05


def test_samples_have_exact_sizes_and_repeat(spark):
    rows = [("hot", k, 1.0 + k % 7) for k in range(5000)] + [("few", k, 2.0) for k in range(3)] + [(None, k, 1.0) for k in range(40)]
    rows += [("odd", 1, None), ("odd", 2, -1.0), ("odd", 3, float("inf")), ("odd", 4, float("nan")), ("odd", None, 1.0), ("odd", 5, 1.0), ("odd", 5, 1.0)]
    df = spark.createDataFrame(rows, "s string, id long, w double").withColumn("key", F.lit(1)).withColumn("salt", F.lit(2))
    draw = lambda d, **x: sorted(map(str, sampling.weighted_sample(d, ["s"], "id", "w", 30, **x).collect()))
    got = sampling.weighted_sample(df, ["s"], "id", "w", 30).collect()
    assert Counter(r["s"] for r in got) == {"hot": 30, "few": 3, None: 30, "odd": 3}
    assert all(sorted(r["place"] for r in got if r["s"] == s) == list(range(1, n + 1)) for s, n in (("hot", 30), (None, 30), ("odd", 3)))
    assert draw(df) == draw(df.repartition(5)) != draw(df, seed=1)
    assert draw(df.limit(0)) == []


# lines


def plain_lines(texts, least):
    split = [(t or "").split("\n") for t in texts]
    held = Counter(x for ls in split for x in {y.strip(" \t\r") for y in ls} if x)
    out = []
    for t, ls in zip(texts, split, strict=True):
        kept = [x for x in ls if held[x.strip(" \t\r")] < least]
        out.append((None if t is None else "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_repeated_lines_go_and_order_stays(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(2)
    common = ["All rights reserved.", " All rights reserved.\t", "", "  ", "Home | About", "\r"]
    texts = ["\n".join(rng.choice([*common, f"line {rng.randrange(30)}", f"own {k}"]) for _ in range(rng.randint(1, 9))) for k in range(80)]
    texts += [None, None, "", "\n\n", texts[3], texts[3], "Home | About\n" * 50]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df = df.withColumn("h", F.lit("clash")).withColumn("_place.x", F.lit(0)).repartition(3)
    got = lines.remove_repeated_lines(df, 4)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == plain_lines(texts, 4)
    assert lines.remove_repeated_lines(df.limit(0)).count() == 0


# graphs


def plain_reach(edges):
    ahead = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            ahead[a].add(b)
    out = set()
    for a in list(ahead):
        seen, todo = set(), list(ahead[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += ahead[b]
        out |= {(a, b) for b in seen}
    return out


def test_reachable_pairs_and_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(33)] + [(133, 100)]
    edges += [(200, 200), (None, 1), (1, None), (200, 200)]
    df = spark.createDataFrame(edges, "a long, b long").withColumn("v", F.lit(0))
    assert {tuple(r) for r in graphs.reachable(df).collect()} == plain_reach(edges)
    both = plain_reach(edges + [(b, a) for a, b in edges])
    want = {(v, min([v, *(b for a, b in both if a == v)])) for v in {a for a, _ in both}}
    assert {tuple(r) for r in graphs.components(df).collect()} == want
    assert graphs.reachable(df.limit(0)).count() == 0 and graphs.components(df.limit(0)).count() == 0
