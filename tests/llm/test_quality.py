from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality as q
from weftline.llm.quality import keep_good, score_documents, train
from weftline.sources import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    seen = labels.where(F.xxhash64("doc_id") % 4 != 0)
    rest = labels.join(seen.select("doc_id"), "doc_id", "left_anti")
    got = score_documents(docs, train(docs, seen)).join(rest, "doc_id").toPandas()
    assert len(got) > 50
    assert np.mean(got["kept"] == got["quality"]) > 0.97
    good = got[got["quality"] == 1]
    assert good["kept"].mean() > 0.97
    assert np.mean((got["content_score"] > 0.5) == got["quality"]) > 0.9


def plain_co_training(docs, labels, labelled_rows, rounds, given_rows, sure):
    """The same exchange over arrays of all documents, with plain sorting."""
    known = {}
    for r in labels:
        known[r["doc_id"]] = min(r["quality"], known.get(r["doc_id"], 9))
    ids = [r["doc_id"] for r in docs]
    x = q.features(*([r[c] for r in docs] for c in ("text", "source", "lang", "n_chars")))
    row = {i: k for k, i in enumerate(ids)}
    order = labelled_rows
    y = np.array([float(known[i] > 0) for i in order])
    own = x[[row[i] for i in order]]
    trains, held = q.split_labelled(y)
    given = [{}, {}]

    def fit(view):
        more = sorted(given[view])
        rows = np.concatenate([own[trains], x[[row[i] for i in more]]])
        return q.fit_linear(rows[:, q.VIEWS[view]], np.concatenate([y[trains], [given[view][i] for i in more]]))

    views = [fit(0), fit(1)]
    for _ in range(rounds):
        handed = []
        for view in (0, 1):
            margin = views[view].margin(x[:, q.VIEWS[view]])
            seen = views[view].margin(own[held][:, q.VIEWS[view]])
            for label, sign in ((0, -1), (1, 1)):
                beyond = q.sure_beyond(sign * seen, y[held] == label, sure)
                free = [i for i in ids if i not in known and i not in given[1 - view] and sign * margin[row[i]] >= beyond]
                best = sorted(free, key=lambda i: (-sign * margin[row[i]], i))[:given_rows]
                handed += [(1 - view, i, label) for i in best]
        for view, i, label in sorted(handed):
            given[view][i] = label
        views = [fit(0), fit(1)]
    return q.finish(views, float(y.mean()), own[held], y[held], tuple(given))


def test_the_exchange_equals_plain_co_training(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    order = [r["doc_id"] for r in labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    got = train(docs, labels, labelled_rows=300, rounds=2, given_rows=20)
    want = plain_co_training(docs.collect(), labels.collect(), order, 2, 20, 0.99)
    assert any(got.given) and got.given == want.given
    for a, b in zip((*got.views, *got.calibrated, got.combined), (*want.views, *want.calibrated, want.combined), strict=True):
        assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_metadata_view_sees_no_text():
    a, b = (q.features([t], ["s"], ["en"], [7]) for t in ("some text\nof two lines", None))
    assert (a[:, q.VIEWS[1]] == b[:, q.VIEWS[1]]).all() and (a[:, q.VIEWS[0]] != b[:, q.VIEWS[0]]).any()


def test_reruns_agree(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    a, b = (train(docs.repartition(n), labels) for n in (2, 5))
    assert np.allclose(a.combined.weights, b.combined.weights)


def test_odd_rows_have_scores(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (6, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(odd, train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = score_documents(odd, train(odd, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5} and all(r["kept"] == 1 for r in none)
    one = train(odd, labels.where("quality = 1 and doc_id = 0"))
    assert one.prior == 1.0


def test_empty_table_and_other_columns(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_documents(empty, train(empty, labels)).count() == 0
    wide = odd.withColumn("score", F.lit("mine")).withColumn("quality", F.lit(3)).withColumn("h", F.lit(1))
    kept = keep_good(wide, train(odd, labels))
    assert kept.columns == wide.columns and kept.count() == wide.count()
