"""Quality classifier by co-training of two views.

One view sees the text's content (byte frequencies, repetition of words, layout of lines), the
other the page's metadata (source, language, declared length) and nothing of the text. Both start
from the same labelled rows. In each round each view scores every unlabelled document and hands the
`given_rows` documents of each class that it is most sure of to the other view as training rows, if
it is right beyond their margin on labelled rows that were held back. In the end each view's margin
is calibrated on those held-back rows, and a third small model combines the calibrated views. Every
document gets a score, the probability of quality 1; a document below the threshold is rejected.

The features of all documents are written once to a table in the shared folder, which the rounds
read. The labelled rows are a bounded sample (`labelled_rows`, those with the smallest hashes), and
so are the rows handed over (`given_rows` for each round, view and class, the method's growth rate;
they are picked from all documents), so the driver fits a few hundred weights from bounded arrays.

Cases: null texts are empty, null metadata has a value of its own; documents without labels are
scored like all others; documents without an id are scored and never handed over; of rows that share
an id one is trained on; labels without a document, with a null quality or a null id don't count,
and of several labels for one document the lowest counts; with no labels, or labels of one class
only, every score is the share of quality 1 (0.5 without labels); an empty table gives an empty
result; other columns are kept by `keep_good` and clash with nothing.
"""

from __future__ import annotations

import operator
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import delete_path, shared_path

CONTENT = 266  #: features of the content view
SOURCES, LANGS, LENGTHS = 64, 16, 20  #: hash slots, and classes of length by powers of two
METADATA = SOURCES + LANGS + LENGTHS + 2
FEATURES = CONTENT + METADATA
VIEWS = (slice(0, CONTENT), slice(CONTENT, FEATURES))
SALTS = 64  #: tasks that look for the surest documents of one view and class


def features(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """Rows of both views side by side."""
    out = np.zeros((len(text), FEATURES), np.float32)
    for row, t, s, g, n in zip(out, text, source, lang, n_chars, strict=True):
        t = t or ""
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        words = t.split()
        row[:256] = np.sqrt(np.bincount(raw, minlength=256) / max(1, len(raw)))
        same = sum(map(operator.eq, words, words[1:]))
        lines = t.split("\n")
        lengths = list(map(len, lines))
        row[256:CONTENT] = (
            len(set(words)) / max(1, len(words)),
            same / max(1, len(words)),
            np.log1p(len(words)),
            len(t) / max(1, len(words)) ** 0.5 / 10,
            not words,
            np.log1p(len(lines)),
            np.log1p(max(lengths)),
            np.log1p(sum(lengths) / len(lines)),
            len(set(lines)) / len(lines),
            min(lengths) / max(1, max(lengths)),
        )
        known = 0 if pd.isna(n) else max(0, int(n))
        row[CONTENT + zlib.crc32(f"{s}".encode("utf-8", "surrogatepass")) % SOURCES] = 1
        row[CONTENT + SOURCES + zlib.crc32(f"{g}".encode("utf-8", "surrogatepass")) % LANGS] = 1
        row[CONTENT + SOURCES + LANGS + min(LENGTHS - 1, known.bit_length())] = 1
        row[FEATURES - 2 :] = np.log1p(known), pd.isna(n)
    return out


@dataclass
class Linear:
    """A logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, balanced: bool = True, rounds: int = 15) -> Linear:
    """Newton steps on the penalised likelihood; balanced: both classes have the same total weight."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale[scale < 1e-6] = 1.0
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if balanced else np.ones(len(y))
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        curvature, slope = np.diag(ridge), ridge * w
        for at in range(0, len(x), 2000):  # the standardised rows are never held whole
            part = slice(at, at + 2000)
            z = np.column_stack([np.ones(len(x[part])), (x[part] - mean) / scale])
            p = sigmoid(z @ w)
            curvature += (z * (importance[part] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
            slope += z.T @ (importance[part] * (p - y[part]))
        step = np.linalg.solve(curvature, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(mean, scale, w)


@dataclass
class CoTrained:
    """Both views, their calibration and the combination; `prior` alone if there was nothing to learn from."""

    prior: float
    views: tuple[Linear, Linear] | None = None
    calibrated: tuple[Linear, Linear] | None = None
    combined: Linear | None = None
    given: tuple[dict[int, int], dict[int, int]] = ({}, {})  # per view: documents it was handed, with their labels

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Columns: content view, metadata view, both."""
        if self.views is None:
            return np.full((len(x), 3), self.prior)
        margins = [
            c.margin(v.margin(part)[:, None])
            for v, c, part in zip(self.views, self.calibrated, (x[:, VIEWS[0]], x[:, VIEWS[1]]), strict=True)
        ]
        both = self.combined.margin(np.clip(np.column_stack(margins), -20, 20))
        return sigmoid(np.column_stack([*margins, both]))


def sure_beyond(margin: np.ndarray, hit: np.ndarray, sure: float, least: int = 8) -> float:
    """The lowest margin from which on a share of `sure` of the held-back rows is right (inf if there is none)."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(hit[order]) / np.arange(1, len(hit) + 1)
    ok = np.flatnonzero((right >= sure) & (np.arange(1, len(hit) + 1) >= least))
    return float(margin[order][ok[-1]]) if len(ok) else np.inf


def split_labelled(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which labelled rows (in random order) train and which are held back: all do both if either part lacked a class."""
    held = np.arange(len(y)) % 4 == 0
    if any(len(set(y[part])) < 2 for part in (held, ~held)):
        return np.ones(len(y), bool), np.ones(len(y), bool)
    return ~held, held


def finish(views: tuple, prior: float, x: np.ndarray, y: np.ndarray, given: tuple) -> CoTrained:
    """Calibrate both views on held-back rows and combine them."""
    calibrated, margins = [], []
    for view, part in zip(views, VIEWS, strict=True):
        m = view.margin(x[:, part])[:, None]
        calibrated.append(fit_linear(m, y, penalty=0.1, balanced=False))
        margins.append(calibrated[-1].margin(m))
    combined = fit_linear(np.clip(np.column_stack(margins), -20, 20), y, penalty=0.1, balanced=False)
    return CoTrained(prior, tuple(views), tuple(calibrated), combined, given)


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (column quality) of a bounded number of rows in the order of h, one for each id."""
    one = rows.groupBy("h", "doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    held = one.orderBy("h", "doc_id").select("quality", "x").toArrow()
    x = np.frombuffer(b"".join(held["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return x, (held["quality"].to_numpy() > 0).astype(np.float64)


def _surest(
    table: DataFrame, quality: DataFrame, views: list[Linear], beyond: np.ndarray, taken: list[list[int]], given_rows: int
) -> list[tuple[int, int, int]]:
    """(view that is handed the row, doc_id, label): of all unlabelled documents those of which the other view is surest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
            for view in (0, 1):
                margin = views[view].margin(x[:, VIEWS[view]])
                free = ~np.isin(ids, taken[1 - view])
                for label, sign in ((0, -1), (1, 1)):
                    some = np.flatnonzero(free & (sign * margin >= beyond[view, label]))
                    slot = np.full(len(some), 2 * (1 - view) + label, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot), pa.array(ids[some]), pa.array(sign * margin[some])], names=["slot", "doc_id", "sure"]
                    )

    found = table.where("doc_id is not null").mapInArrow(run, "slot int, doc_id long, sure double")
    fresh = found.join(quality, "doc_id", "left_anti").groupBy("slot", "doc_id").agg(F.max("sure").alias("sure"))
    # the best of some parts first, so that no task ranks all documents
    dealt = fresh.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (("slot", "part"), ("slot",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sure"), "doc_id"))
        dealt = dealt.withColumn("place", place).where(F.col("place") <= given_rows)
    return [(r["slot"] // 2, r["doc_id"], r["slot"] % 2) for r in dealt.select("slot", "doc_id").collect()]


SCORES = "content_score double, metadata_score double, score double"


def train(
    docs: DataFrame,
    labels: DataFrame,
    labelled_rows: int = 12_000,
    rounds: int = 3,
    given_rows: int = 500,
    sure: float = 0.99,
) -> CoTrained:
    """Fit on a bounded sample of labels (doc_id, quality) and on documents without one that the views hand each other."""
    spark = docs.sparkSession
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    known = quality.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(labelled_rows)
    made = F.pandas_udf(lambda *c: pd.Series([r.tobytes() for r in features(*c)], dtype=object), "binary")
    folder = shared_path(spark, f"features-{uuid.uuid4().hex}")
    try:
        docs.select("doc_id", made("text", "source", "lang", "n_chars").alias("x")).write.option(
            "compression", "zstd"
        ).parquet(folder)
        table = spark.read.schema("doc_id long, x binary").parquet(folder)
        # at most labelled_rows ids
        x, y = _arrays(table.join(F.broadcast(known), "doc_id"))
        if len(y) == 0 or y.min() == y.max():
            return CoTrained(float(y.mean()) if len(y) else 0.5)
        trains, held = split_labelled(y)
        given: list[dict[int, int]] = [{}, {}]  # per view: documents it was handed, with their labels

        def fit(view: int) -> Linear:
            own_x, own_y = x[trains][:, VIEWS[view]], y[trains]
            if given[view]:
                rows = spark.createDataFrame(sorted(given[view].items()), "doc_id long, quality int")
                more, label = _arrays(table.join(F.broadcast(rows), "doc_id").withColumn("h", F.lit(0)))
                own_x, own_y = np.concatenate([own_x, more[:, VIEWS[view]]]), np.concatenate([own_y, label])
            return fit_linear(own_x, own_y)

        views = [fit(0), fit(1)]
        for _ in range(rounds):
            seen = [v.margin(x[held][:, part]) for v, part in zip(views, VIEWS, strict=True)]
            beyond = np.array(
                [[sure_beyond(sign * m, y[held] == label, sure) for label, sign in ((0, -1), (1, 1))] for m in seen]
            )
            if not np.isfinite(beyond).any():
                break
            taken = [sorted(g) for g in given]
            handed = _surest(table, quality, views, beyond, taken, given_rows)
            for view, doc_id, label in sorted(handed):
                given[view][doc_id] = label
            if not handed:
                break
            views = [fit(0), fit(1)]
        return finish(tuple(views), float(y.mean()), x[held], y[held], tuple(given))
    finally:
        delete_path(spark, folder)


def score_column(model: CoTrained) -> Column:
    """A struct of the scores of a document's row (text, source, lang, n_chars)."""

    def run(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        found = [
            model.scores(features(text[a : a + 500], source[a : a + 500], lang[a : a + 500], n_chars[a : a + 500]))
            for a in range(0, len(text), 500)
        ]
        names = [c.split()[0] for c in SCORES.split(", ")]
        return pd.DataFrame(np.concatenate([np.zeros((0, 3)), *found]), columns=names)

    return F.pandas_udf(run, SCORES)("text", "source", "lang", "n_chars")


def score_documents(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """doc_id, the scores and whether the document is kept."""
    scored = docs.select("doc_id", score_column(model).alias("s"))
    return scored.select("doc_id", "s.*", (F.col("s.score") >= threshold).cast("int").alias("kept"))


def keep_good(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    return docs.where(score_column(model)["score"] >= threshold)
