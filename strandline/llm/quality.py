"""Quality by naive Bayes support vectors: n-gram indicators scaled by the class
log-count ratio, and a linear hinge-loss model fitted by dual coordinate descent.

Words and word pairs are hashed to ``1 << BITS`` features, so the model is of
one size whatever the corpus.  It is fitted on a bounded sample of labelled
texts (``most_rows`` rows of at most ``most_bytes`` bytes in all); scoring
reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices
from strandline.llm.toxicity import held_out, labelled_rows

__all__ = ["QualityModel", "features", "fit", "held_out", "labelled_features", "score_texts", "train"]

BITS = 20
SMOOTH = 1.0
COST = 0.05
EPOCHS = 15
MOST_ROWS = 12_000
MOST_BYTES = 48_000_000
_PAIR = np.uint32(0x9E3779B1)


@dataclass
class QualityModel:
    """Weights of the features with the ratios in them, the intercept, and the
    slope and shift that turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def features(text: str | None) -> np.ndarray:
    """Distinct hashed words and word pairs of a text in lower case."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint32)
    one = np.fromiter(map(crc32, words), np.uint32, len(words))
    two = (one[:-1] * _PAIR) ^ (one[1:] + np.uint32(1))
    return np.unique(np.concatenate((one, two)) & np.uint32((1 << BITS) - 1))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (smoothed share of a feature in class 1 / in class 0)."""
    counts = np.full((2, 1 << BITS), SMOOTH)
    for r, v in zip(rows, y):
        counts[0 if v == 1 else 1, r] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over indicator * ratio.

    Each step sets one dual variable to its best value within 0 and its row's
    cost; rows of the two classes share the cost evenly."""
    sign = np.where(y > 0, 1.0, -1.0)
    limit = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    alpha, w, bias = np.zeros(len(y)), np.zeros(1 << BITS), 0.0
    root = np.sqrt([max(1, len(r)) for r in rows])
    norm = np.array([1.0 + float(ratio[r] @ ratio[r]) / n**2 for r, n in zip(rows, root)])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            value = ratio[rows[i]] / root[i]
            slack = sign[i] * (float(w[rows[i]] @ value) + bias) - 1.0
            new = min(max(alpha[i] - slack / norm[i], 0.0), limit[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * sign[i] * value
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * ratio, bias


def _margin(model: QualityModel, row: np.ndarray) -> float:
    return float(model.weights[row].sum()) / np.sqrt(max(1, len(row))) + model.bias


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels of the training set by doc_id.  Executors read the
    texts; the driver gets only the features, a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pa.array([features(t.as_py()).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), found], ["doc_id", "label", "features"])

    rows = labelled_rows(docs, labels, label, allowed, MOST_ROWS, MOST_BYTES)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(run, "doc_id long, label int, features binary")
    kept = sorted(((r["doc_id"], r["label"], np.frombuffer(bytes(r["features"]), np.uint32)) for r in rows.toLocalIterator()), key=lambda r: r[0])
    return [f for _, _, f in kept], [v for _, v, _ in kept]


def train(texts: list[str | None], labels: list[int]) -> QualityModel:
    """A model of the texts."""
    return fit([features(t) for t in texts], labels)


def fit(rows: list[np.ndarray], labels: list[int]) -> QualityModel:
    """A model of the rows of features; margins of a fifth of the rows, kept out of a first
    fit, calibrate the probabilities.  With one class only, or none, every
    score is the share of class 1 (0.5 of none)."""
    y = np.array(labels, dtype=int)
    if not 0 < y.sum() < len(y):
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(p / (1 - p))))
    own = np.arange(len(y)) % 5 != 0
    if not 0 < y[own].sum() < own.sum() or not 0 < y[~own].sum() < (~own).sum():
        own[:] = True
    fit_rows, fit_y = [r for r, k in zip(rows, own) if k], y[own]
    ratio = log_count_ratio(fit_rows, fit_y)
    first = QualityModel(*dual_descent(fit_rows, fit_y, ratio), 1.0, 0.0)
    away = ~own if not own.all() else own
    slope, shift = _sigmoid(np.array([_margin(first, r) for r, k in zip(rows, away) if k]), y[away])
    ratio = log_count_ratio(rows, y)
    weights, bias = dual_descent(rows, y, ratio)
    return QualityModel(weights, bias, slope, shift)


def _sigmoid(margin: np.ndarray, y: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope and shift of the log-odds over margins, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-7:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score(model: QualityModel, text: str | None) -> float:
    """Probability of label 1."""
    z = model.slope * _margin(model, features(text)) + model.shift
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score_texts(docs: DataFrame, model: QualityModel, threshold: float = 0.7, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every row, and the long columns ``also``.

    Whole texts are read, null as empty.  Repeated rows score alike, an empty
    table gives none."""
    small = QualityModel(model.weights.astype(np.float32), model.bias, model.slope, model.shift)
    sent = docs.sparkSession.sparkContext.broadcast(small)
    names = ["doc_id", *(also or {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = np.array([score(sent.value, t.as_py()) for t in b.column("text")], dtype=np.float64)
            kept = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"{n} long" for n in names) + ", score double, predicted int"
    rows = docs.select(F.col("doc_id").cast("long"), *(c.alias(n) for n, c in (also or {}).items()), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema)
