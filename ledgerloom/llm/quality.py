"""Quality by co-training: one classifier reads the text, one the page's metadata, and each teaches the other.

Both are logistic regressions, fitted on a bounded sample of labelled rows. In each round a view judges all unlabelled documents, and some of
those that it is sure of, drawn from all of them by a hash of their id, join the other view's training rows. At the end each view is calibrated on labelled rows left aside, and the
calibrated log odds are combined with weights fitted on the same rows. All documents are then scored. Features are computed once and kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches

#: Labelled rows that the views are fitted on, at most; rounds; pseudo-labels of each class that a view hands over in a round, at most.
LABELLED, ROUNDS, HANDED = 6000, 3, 500
SURE, PARTS = 0.9, 64  # least probability of a pseudo-label; parts in which they are drawn first
_BUCKETS = 32
_SYMBOLS = "#%$&*|<>{}[]=_~^"


def text_view(text: str) -> list[float]:
    words, n = text.split(), max(len(text), 1)
    k, lines = max(len(words), 1), text.split("\n")
    return [
        np.log1p(len(words)), len(set(words)) / k, min(len(text) / k, 40.0) / 10, sum(map(text.count, _SYMBOLS)) / n * 10, text.count("|") / k, text.count(".") / k * 5, text.count(",") / k * 5,
        sum(map(text.count, "0123456789")) / n * 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, 1 - len(set(lines)) / len(lines), float(text[-1:] in {".", "!", "?"}), float(not text),
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (2 * _BUCKETS + 3)
    out[zlib.crc32((lang or "").encode()) % _BUCKETS] = 1.0
    out[_BUCKETS + zlib.crc32((source or "").encode()) % _BUCKETS] = 1.0
    size = np.log1p(max(n_chars or 0, 0)) / 5
    out[-3:] = [size, size * size, float(n_chars is None)]
    return out


#: Features of each view.
TEXT, METADATA = len(text_view("")), len(metadata_view(None, None, None))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the bias comes last and is hardly held back."""
    x = np.column_stack([x, np.ones(len(x))])
    weight, hold = np.ones(len(x)) if weight is None else weight, np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (weight * (p - y)) + hold * w)
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift that turn a view's log odds into calibrated ones."""
    w = fit_logistic(x[:, None], y, ridge=1e-2)
    return np.array([max(w[0], 0.0), w[1]])


def finish(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, weights: list[np.ndarray]) -> tuple:
    """The model (text weights, metadata weights, calibration of each, combination) from labelled rows left aside."""
    raw = [odds(views[v], weights[v]) for v in (0, 1)]
    scales = [calibrate(r, y) for r in raw]
    both = np.column_stack([r * scale[0] + scale[1] for r, scale in zip(raw, scales, strict=True)])
    return weights[0], weights[1], scales[0], scales[1], fit_logistic(both, y)


def base_rate(y: np.ndarray) -> tuple:
    """A model that gives every document the share of good labels, where labels don't suffice to learn."""
    base = ((y == 1).sum() + 1) / ((y >= 0).sum() + 2)
    return np.zeros(TEXT + 1), np.zeros(METADATA + 1), np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 0.0, np.log(base / (1 - base))])


def _features(batches):
    for batch in batches:
        ids, texts, langs, sources, sizes = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([text_view(t or "") for t in texts], pa.list_(pa.float64())), pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(sizes, pa.int64())],
            names=["id", "text_view", "lang", "source", "n_chars"],
        )


FEATURES = "id long, text_view array<double>, lang string, source string, n_chars long"


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of the rows of FEATURES."""
    text = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, TEXT)
    metadata = np.array([metadata_view(*m) for m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)], float).reshape(batch.num_rows, METADATA)
    return text, metadata


def _sure(weights: list[np.ndarray]):
    """Rows of FEATURES that a view is sure of, once for each such view, with the view and its label."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for v, x in enumerate(_views(batch)):
                p = 1 / (1 + np.exp(-odds(x, weights[v])))
                keep = np.flatnonzero(np.maximum(p, 1 - p) >= SURE)
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(keep)).columns, pa.array(np.full(len(keep), v, np.int32)), pa.array((p[keep] > 0.5).astype(np.int32))], names=["id", "text_view", "lang", "source", "n_chars", "view", "label"]
                )

    return run


def _scored(model: tuple):
    def run(batches):
        for batch in batches:
            views = _views(batch)
            a, b = (odds(views[v], model[v]) * model[2 + v][0] + model[2 + v][1] for v in (0, 1))
            p = 1 / (1 + np.exp(-odds(np.column_stack([a, b]), model[4])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(np.round(p, 9))], names=["id", "text_odds", "metadata_odds", "score"])

    return run


def _collected(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(views, labels, ids) of a bounded table of FEATURES and label."""
    got = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    text = np.array([r.text_view for r in got], float).reshape(len(got), TEXT)
    metadata = np.array([metadata_view(r.lang, r.source, r.n_chars) for r in got], float).reshape(len(got), METADATA)
    return (text, metadata), np.array([r.label for r in got], int), np.array([r.id for r in got], np.int64)


def co_train(features: DataFrame, taught: DataFrame, known: DataFrame) -> tuple:
    """The model of both views. features: FEATURES of all documents; taught: at most LABELLED ids with label; known: ids that have a label, held out or not."""
    one = features.join(F.broadcast(taught), "id").groupBy("id").agg(F.min_by(F.struct("text_view", "lang", "source", "n_chars"), F.hash("text_view", "lang", "source", "n_chars")).alias("f"), F.max("label").alias("label"))
    views, y, _ = _collected(one.select("id", "f.*", "label"))
    aside = np.arange(len(y)) % 5 == 0
    if len(y) < 10 or len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        return base_rate(y)
    free = features.filter("id is not null").join(known.select("id"), "id", "left_anti")
    train = [(views[v][~aside], y[~aside]) for v in (0, 1)]
    weights = [fit_logistic(*train[v]) for v in (0, 1)]
    for _ in range(ROUNDS):
        sure = free.mapInArrow(_sure(weights), FEATURES + ", view int, label int").dropDuplicates(["id", "view"])
        first = lambda rows, *keys: rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id"))).filter(F.col("n") <= HANDED)
        # The first HANDED of each part, then of those: no task sorts what all tasks found.
        drawn = first(first(sure.withColumn("part", F.pmod(F.hash("id"), F.lit(PARTS))), "view", "label", "part"), "view", "label").drop("part")
        for v in (0, 1):
            handed, labels, _ = _collected(drawn.filter(F.col("view") == 1 - v).drop("view", "n"))
            if len(labels):
                train[v] = (np.concatenate([views[v][~aside], handed[v]]), np.concatenate([y[~aside], labels]))
        weights = [fit_logistic(*train[v]) for v in (0, 1)]
    return finish((views[0][aside], views[1][aside]), y[aside], weights)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document from 0 to 1: (doc_id, held_out, text_odds, metadata_odds, score, predicted); the odds are calibrated.

    Labels are learnt only from rows that are not held out. Nulls: a null text counts as empty, null metadata has values of its own, null labels are left
    out, a null id is scored and not held out. Repeated rows are scored alike and teach once; texts of any length are read whole. Without labels of both kinds every document gets the base rate.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    features = scratch.keep(rows.mapInArrow(_features, FEATURES))
    known = scratch.keep(labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label")))
    taught = scratch.keep(known.filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(LABELLED))
    model = co_train(features, taught, known)
    scored = features.mapInArrow(_scored(model), "id long, text_odds double, metadata_odds double, score double")
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "text_odds", "metadata_odds", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
