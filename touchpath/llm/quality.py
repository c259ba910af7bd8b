"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good, one from text labelled bad. A text that resembles the
good text shrinks more with the good dictionary. The difference of the two compressed sizes, divided by their sum, is
calibrated to a probability on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import text_batches
from touchpath.llm.training import fit_logistic, labelled_sample, sigmoid


@dataclass(frozen=True)
class QualityOptions:
    """``rows_per_class`` bounds the labelled rows read for training; half builds dictionaries, half calibrates.

    Texts are compressed whole, in pieces of ``piece_bytes``, so that a long text cannot outgrow the dictionary. A class's
    dictionary is built from at most ``pieces_per_class`` pieces, drawn by hash from all pieces of its whole texts.
    """

    rows_per_class: int = 1500
    pieces_per_class: int = 6000
    piece_bytes: int = 1024
    dictionary_bytes: int = 65_536
    level: int = 3
    threshold: float = 0.7


OPTIONS = QualityOptions()


def _pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def _dictionary(pieces: list[bytes], options: QualityOptions) -> bytes:
    """A trained dictionary. From too few or too different pieces zstandard builds none: then their raw content serves."""
    size = min(options.dictionary_bytes, sum(map(len, pieces)) // 2)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-options.dictionary_bytes :]


class CompressionModel:
    """Two dictionaries and the weights of the calibration; small enough to send with the tasks."""

    def __init__(self, good: list[bytes], bad: list[bytes], options: QualityOptions = OPTIONS):
        """From pieces of good and of bad texts."""
        self.good, self.bad, self.options = _dictionary(good, options), _dictionary(bad, options), options
        self.weights = np.zeros(7)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        plain = {"level": self.options.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) < 8:  # zstandard takes no shorter dictionary
            return zstandard.ZstdCompressor(**plain)
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=self.options.level)
        return zstandard.ZstdCompressor(dict_data=dictionary, **plain)

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes: plain, compressed with the good dictionary, with the bad one."""
        if not hasattr(self, "_compressors"):
            self._compressors = self._compressor(self.good), self._compressor(self.bad)
        data = (text or "").encode()
        pieces = _pieces(data, self.options.piece_bytes)
        return len(data), *(sum(len(c.compress(p)) for p in pieces) for c in self._compressors)

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        plain, good, bad = np.array([self.sizes(t) for t in texts], dtype=float).reshape(-1, 3).T
        difference = (bad - good) / np.maximum(bad + good, 1)
        ratio = np.log((np.minimum(good, bad) + 8) / (plain + 8))
        length = np.log(plain + 8)
        return np.stack([np.ones_like(plain), difference, ratio, difference * ratio, ratio**2, length, difference * length], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of ``texts``; a text without a word offers nothing to learn from and scores 0."""
        blank = np.array([not (t or "").encode().split() for t in texts], dtype=bool)
        return np.where(blank, 0.0, sigmoid(self.features(texts) @ self.weights))


def _drawn(rows: DataFrame, label: int, options: QualityOptions) -> list[bytes]:
    """Pieces of the texts of ``label``, drawn by hash: a bounded top-k of all of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_pieces(text.encode(), options.piece_bytes), pa.binary())], ["piece"])

    pieces = text_batches(rows.where(F.col("label") == label).select("text")).mapInArrow(cut, "piece binary")
    chosen = pieces.orderBy(F.xxhash64("piece"), "piece").limit(options.pieces_per_class)
    return [bytes(r["piece"]) for r in chosen.collect()]


def _measured(rows: DataFrame, model: CompressionModel) -> list:
    """(features, label, weight) of every row; the texts stay in the tasks."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.features(batch.column(0).to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), *batch.columns[1:]], ["features", "label", "weight", "doc_id"])

    source = text_batches(rows.select("text", "label", "weight", "doc_id"))
    found = source.mapInArrow(measure, "features array<double>, label int, weight double, doc_id long").collect()
    return sorted(found, key=lambda r: (r["doc_id"], r["label"]))


def train(docs: DataFrame, labels: DataFrame, options: QualityOptions = OPTIONS) -> CompressionModel:
    """Fit on at most ``rows_per_class`` rows of ``labels`` (``doc_id``, ``label`` 0 or 1) of each class.

    Half of them by hash build the dictionaries, the others calibrate (all, if a half is empty).
    """
    rows = labelled_sample(docs, labels, options.rows_per_class)
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2))
    build, check = rows.where(half == 0), rows.where(half == 1)
    model = CompressionModel(*(_drawn(build, k, options) for k in (1, 0)), options)
    found = _measured(check, model) or _measured(rows, model)
    if found:
        model.weights = fit_logistic(*(np.array([r[c] for r in found]) for c in ("features", "label", "weight")))
    return model


def quality_scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``score`` (0 to 1, higher is better), ``predicted`` (0 or 1).

    Reads ``doc_id`` and ``text`` only. Null, empty and blank texts score 0; an untrained model gives all others 0.5. Repeated rows and null ids are scored like any other. No shuffle.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(1).to_pylist())
            predicted = (scores >= model.options.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(predicted)], ["doc_id", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(source).mapInArrow(score, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows of ``docs`` with all their columns whose ``text`` scores at least the threshold; see ``quality_scores``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(scores >= model.options.threshold, pa.bool_()))

    source = docs.withColumn("text", F.col("text").cast("string"))
    return text_batches(source).mapInArrow(keep, source.schema)
