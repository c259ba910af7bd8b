"""Quality rules: how much of a text repeats itself.

Words are hashed once; the hash of an n-gram grows from the hash of the (n-1)-gram at the same place, so all lengths
share one pass. For each length the characters inside n-grams that occur more than once are measured.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import WORD, text_batches

_WORDS = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest allowed shares of a text's word characters.

    ``top`` bounds the most frequent n-gram of a short length, ``covered`` all repeated n-grams of a long length
    together (first occurrences included), ``line_chars`` the lines equal to an earlier line, ``symbol_words`` the
    symbols per word.
    """

    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    covered: tuple[tuple[int, float], ...] = ((5, 0.40), (6, 0.38), (7, 0.36), (8, 0.34), (9, 0.32), (10, 0.30))
    line_chars: float = 0.30
    symbol_words: float = 0.25


LIMITS = RepetitionLimits()

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "top_share double, covered_share double, dup_line_share double, symbol_share double, "
    "base_failed boolean, kept boolean"
)


def _repeated(grams: np.ndarray) -> np.ndarray | None:
    """Marks the n-grams that occur more than once; None if there are none."""
    if len(grams) < 2:
        return None
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return None
    again = np.unique(again)
    at = np.minimum(np.searchsorted(again, grams), len(again) - 1)
    return again[at] == grams


def _covered(marks: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside a marked n-gram."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(marks)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None, limits: RepetitionLimits = LIMITS) -> tuple:
    """The measures of one text, in the order of ``SCHEMA`` after ``doc_id``."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(lengths.sum())
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, _WORDS.findall(line)))
        elif _WORDS.search(line):
            seen.add(line)
    wanted_top, wanted_covered = dict(limits.top), dict(limits.covered)
    base = np.zeros(n, dtype=bool)
    top_over = covered_over = False
    top_share = covered_share = 0.0
    grams = hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    for size in range(2, 1 + max([limits.base_window, *wanted_top, *wanted_covered])):
        if n < size:
            break
        grams = grams[:-1] * _STEP
        grams ^= grams >> _SHIFT
        grams = (grams + hashes[size - 1 :]) * _MIX
        marks = _repeated(grams)
        if marks is None:
            break  # no longer n-gram can repeat
        covered = _covered(marks, size, n)
        if size == limits.base_window:
            base = covered
        if size in wanted_top:
            at = np.flatnonzero(marks)
            _, first, counts = np.unique(grams[at], return_index=True, return_counts=True)
            start = at[first]
            share = int(((ends[start + size] - ends[start]) * counts).max()) / chars
            top_share = max(top_share, share)
            top_over |= share > wanted_top[size]
        if size in wanted_covered:
            share = int(lengths[covered].sum()) / chars
            covered_share = max(covered_share, share)
            covered_over |= share > wanted_covered[size]
    repeat_words = int(base.sum())
    line_share = dup_chars / chars if chars else 0.0
    symbol_share = symbols / n if n else 0.0
    base_failed = n < limits.min_words or 100 * repeat_words > limits.base_percent * n
    over = top_over or covered_over or line_share > limits.line_chars or symbol_share > limits.symbol_words
    return (
        n, chars, symbols, dup_lines, repeat_words, top_share, covered_share, line_share, symbol_share,
        base_failed, not (base_failed or over),
    )


def repetition_rules(docs: DataFrame, limits: RepetitionLimits = LIMITS) -> DataFrame:
    """One row of measures and verdict per row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Null and empty texts have no words, so they fail the base rule. Repeated rows and null ids are judged like any
    other row. An empty table gives no rows. Row by row, no shuffle; a text of any length is measured whole.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text, limits) for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()] * 2
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(source).mapInArrow(judge, SCHEMA)
