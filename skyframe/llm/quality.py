"""Quality classifier: naive Bayes support vectors (NB-SVM).

Indicators of hashed n-grams are scaled by class log-count ratios; a linear
hinge-loss model over the scaled, normalised rows is fit by dual coordinate
descent and mixed with its mean magnitude; a sigmoid fit on rows the model did
not learn from turns margins into scores.

n-grams: words, word pairs, word pairs of word endings (the last three bytes),
endings, and whether a word repeats the one before it.  Scores read nothing but
the text.  Learning uses at most about ``bound`` labelled rows (a documented
parameter; chosen by identifier).  A null or empty text has no indicators and
gets the score of a zero margin.  Without labels of both classes the score is
the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds
from .textcore import Chunk, chunks, mix64

BITS, BOUND, CUTOFF = 18, 6000, 0.3


def indicators(c: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, sorted by text, and where each text's begin."""
    tail = c.hashes(np.maximum(c.starts, c.ends - 3), c.ends)
    two, at = c.grams(2)
    ends, _ = c.grams(2, tail)
    same = np.flatnonzero((c.words[1:] == c.words[:-1]) & (c.doc[1:] == c.doc[:-1]))
    h = np.concatenate([c.words, two, mix64(ends ^ np.uint64(1)), mix64(tail ^ np.uint64(2)), np.full(len(same), 3, np.uint64)])
    doc = np.concatenate([c.doc, c.doc[at], c.doc[at], c.doc, c.doc[same]])
    key = np.sort(doc << bits | (h >> np.uint64(64 - bits)).astype(np.int64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(c.n + 1))


@dataclass
class Model:
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margins(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.zeros((2, len(features) + 1))
        np.cumsum((self.scale * self.weight)[features], out=sums[0, 1:])
        np.cumsum((self.scale**2)[features], out=sums[1, 1:])
        dot, square = np.diff(sums[:, offsets])
        return dot / np.sqrt(np.maximum(square, 1e-12))

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features, offsets) + self.shift, -500, 500)))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; rows have unit length. cost: the greatest dual value of each row."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, x = rows[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ x) - 1), 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _sigmoid(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1) by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + 1e-2 * a, (p - y).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-2, (s * m).sum()], [(s * m).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0, beta: float = 0.25, epochs: int = 30) -> Model:
    """rows: each text's feature numbers. labels: 0 or 1."""
    size, y = 1 << bits, np.asarray(labels, np.int64)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log(p / (1 - p))))
    test = np.arange(len(y)) % 5 == 0
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test = np.zeros(len(y), bool)
    train = np.flatnonzero(~test)
    counts = np.ones((2, size))
    for i in train:
        counts[y[i], rows[i]] += 1
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for i in train:
        x = scale[rows[i]]
        values.append(x / max(np.sqrt(x @ x), 1e-6))
    sign, share = 2 * y[train] - 1, y[train].mean()
    w = _descend([rows[i] for i in train], values, sign, size, np.where(sign > 0, cost * 0.5 / share, cost * 0.5 / (1 - share)), epochs)
    w = beta * np.abs(w).mean() * np.ones(size) + (1 - beta) * w
    model = Model(scale, w, 1.0, 0.0)
    at = np.flatnonzero(test) if test.any() else train
    offsets = np.concatenate([[0], np.cumsum([len(rows[i]) for i in at])])
    model.slope, model.shift = _sigmoid(model.margins(np.concatenate([rows[i] for i in at]), offsets), y[at])
    return model


def learn(docs: DataFrame, labels: DataFrame, bits: int = BITS, bound: int = BOUND) -> Model:
    """docs: rows that may be learned from. labels: doc_id, quality; of an identifier's several labels the least counts."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = folds.bounded_sample(marked.where(~folds.held_out(F.col("doc_id"))), "doc_id", bound)
    # of rows that repeat an identifier, the one whose text hashes least: at most about ``bound`` rows come
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("text"))
    chosen = texts.groupBy("doc_id", "quality").agg(F.min_by("text", "h").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, c in chunks(b.column("text")):
                at, offsets = indicators(c, bits)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("quality").slice(lo, hi - lo), lists], ["doc_id", "quality", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = chosen.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, f"doc_id {kind}, quality int, features array<int>").toArrow()
    got = got.sort_by("doc_id")
    rows = [np.asarray(x.values) for x in got.column("features")]
    return fit(rows, np.asarray(got.column("quality")), bits)


def score(docs: DataFrame, model: Model, bits: int = BITS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score, predicted of every row of docs."""
    model = Model(model.scale.astype(np.float32), model.weight.astype(np.float32), model.slope, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, c in chunks(b.column("text")):
                p = model.scores(*indicators(c, bits))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(p), pa.array((p >= cutoff).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, bits: int = BITS, bound: int = BOUND) -> DataFrame:
    model = learn(docs.where(~folds.held_out(F.col("doc_id"))), labels, bits, bound)
    return score(docs, model, bits).select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
