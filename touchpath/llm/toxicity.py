"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import text_batches
from touchpath.llm.training import labelled_sample, sigmoid


@dataclass(frozen=True)
class ToxicityOptions:
    """``rows_per_class`` bounds the labelled rows read for training; their texts are read whole, in the tasks.

    n-grams of bytes are hashed into ``2 ** bits`` features; those in fewer than ``min_rows`` training rows or with a
    log-count ratio below ``min_ratio``, or whose shares in the classes differ by less than ``min_deviations`` standard
    deviations, carry no weight: chance alone would add up over a very long text.
    """

    rows_per_class: int = 2000
    lengths: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    min_rows: int = 4
    min_ratio: float = 1.0
    min_deviations: float = 3.0
    penalty: float = 1e-3
    threshold: float = 0.5


OPTIONS = ToxicityOptions()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _normal(text: str | None) -> bytes:
    """Lower case, single spaces, a space at both ends: word borders are part of an n-gram."""
    words = (text or "").lower().encode().split()
    return b" " + b" ".join(words) + b" " if words else b""


def features(data: bytes, options: ToxicityOptions) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, one array for each length."""
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    packed = codes
    for n in range(2, max(options.lengths) + 1):
        if len(packed) < 2:
            return
        packed = (packed[:-1] << np.uint64(8)) | codes[n - 1 :]
        if n in options.lengths:
            keyed = (packed + (np.uint64(n) << np.uint64(56))) * _MIX
            keyed ^= keyed >> np.uint64(29)
            yield (keyed * _MIX) >> np.uint64(64 - options.bits)


class NgramModel:
    """A weight for each feature (their ratio and coefficient multiplied) and a constant."""

    def __init__(self, options: ToxicityOptions = OPTIONS):
        self.options, self.constant = options, 0.0
        self.weights = np.zeros(1 << options.bits, dtype=np.float32)

    def score(self, text: str | None) -> float:
        total = self.constant
        for numbers in features(_normal(text), self.options):
            hits = numbers[self.weights[numbers] != 0]
            if len(hits):
                total += float(self.weights[np.unique(hits)].sum(dtype=np.float64))
        return total


def present(text: str | None, options: ToxicityOptions) -> np.ndarray:
    """Distinct feature numbers of a whole text."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *features(_normal(text), options)])).astype(np.int64)


def _counts(rows: DataFrame, options: ToxicityOptions) -> np.ndarray:
    """Rows of each class that hold each feature; features of fewer than ``min_rows`` rows count 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << options.bits), dtype=np.int64)
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found[label, present(text, options)] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], ["feature", "n0", "n1"])

    parts = text_batches(rows.select("text", "label")).mapInArrow(count, "feature long, n0 long, n1 long")
    sums = parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= options.min_rows).toArrow()
    counts = np.zeros((2, 1 << options.bits))
    counts[0, sums["feature"].to_numpy()], counts[1, sums["feature"].to_numpy()] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    return counts


def log_count_ratios(counts: np.ndarray, rows: np.ndarray, options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of every feature, and which features are used; ``rows`` are the training rows of each class."""
    shares = (counts + 1) / (rows[:, None] + 2)
    ratio = np.log(shares[1] / shares[0])
    seen, n = counts.sum(axis=0), rows.sum()
    used = (seen >= options.min_rows) & (np.abs(ratio) >= options.min_ratio)
    if rows.all():
        spread = seen / n * (1 - seen / n) * (1 / rows[1] + 1 / rows[0])
        used &= np.abs(shares[1] - shares[0]) >= options.min_deviations * np.sqrt(spread)
    return ratio, used


def _columns(rows: DataFrame, used: np.ndarray, options: ToxicityOptions) -> list:
    """(label, numbers among the used features) of every row."""
    number = np.full(len(used), -1, dtype=np.int32)
    number[used] = np.arange(int(used.sum()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [number[present(text, options)] for text in batch.column(0).to_pylist()]
            lists = pa.array([x[x >= 0].tolist() for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], ["features", "label", "doc_id"])

    found = text_batches(rows.select("text", "label", "doc_id")).mapInArrow(look, "features array<int>, label int, doc_id long").collect()
    return sorted(found, key=lambda r: (r["doc_id"], r["label"]))


def _fit(found: list, ratio: np.ndarray, used: np.ndarray, options: ToxicityOptions) -> NgramModel:
    model = NgramModel(options)
    y = np.array([r["label"] for r in found], dtype=np.float64)
    row = np.repeat(np.arange(len(found)), [len(r["features"]) for r in found])
    column = np.concatenate([np.empty(0, np.int64), *(np.array(r["features"], np.int64) for r in found)])
    value = ratio[used][column]
    coefficients, constant = np.zeros(int(used.sum())), 0.0
    # Adam on the whole bounded sample, both classes of equal weight.
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    first, second, step = np.zeros(len(coefficients) + 1), np.zeros(len(coefficients) + 1), 0.05
    for t in range(1, 201):
        margin = np.bincount(row, coefficients[column] * value, len(found)) + constant
        error = balance * (sigmoid(margin) - y)
        gradient = np.append(np.bincount(column, error[row] * value, len(coefficients)) + options.penalty * coefficients, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        coefficients -= move[:-1]
        constant -= move[-1]
    model.weights[used] = coefficients * ratio[used]
    model.constant = float(constant)
    return model


def train(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = OPTIONS) -> NgramModel:
    """Fit on at most ``rows_per_class`` rows of ``labels`` (``doc_id``, ``label`` 0 or 1) of each class.

    Counts of features and the used features of each row meet on the driver, no text.
    """
    rows = labelled_sample(docs, labels, options.rows_per_class)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return NgramModel(options)
    ratio, used = log_count_ratios(_counts(rows, options), np.array([totals.get(k, 0) for k in (0, 1)], dtype=np.float64), options)
    return _fit(_columns(rows, used, options), ratio, used, options)


def toxicity_scores(docs: DataFrame, model: NgramModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``score`` (0 to 1, higher is more toxic), ``predicted`` (0 or 1).

    Reads ``doc_id`` and ``text`` only. Null, empty and blank texts have no n-gram and get the score of the constant;
    an untrained model scores 0.5. Repeated rows and null ids are scored like any other. No shuffle; the weights
    (``2 ** bits`` floats) are the only broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = sigmoid(np.array([own.score(t) for t in batch.column(1).to_pylist()], dtype=np.float64))
            predicted = (scores >= own.options.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(predicted)], ["doc_id", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(source).mapInArrow(score, "doc_id long, score double, predicted int")
