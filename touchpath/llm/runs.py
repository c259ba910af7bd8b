"""Periodic runs of words: enhanced suffix array with the branching-tandem test.

A run of period d that ends before word e has exactly one square that cannot be extended to the right: it starts at
i = e - 2d, and the suffixes i and i + d share d words and no more, so they lie in different children of an LCP interval
of depth d. For each interval only the suffixes of its smaller children are looked at, and i + d and i - d are found by
the inverse suffix array. The squares are rotated left as far as they go, and squares of one stretch merge into a run.

The texts of a batch share one suffix array over disjoint alphabets, so numpy works on all of them at once; intervals
come from nearest smaller values of the LCP array, not from a tree.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import WORD, text_batches

_WORDS = re.compile(WORD)


@dataclass(frozen=True)
class RunOptions:
    """A run has at least ``min_words`` words and ``2 * period``. ``block_words`` words share a suffix array, or one text."""

    min_words: int = 12
    block_words: int = 150_000


OPTIONS = RunOptions()
Words = list[str]


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: dense ranks of all suffixes by their first 2**k words, until all ranks differ.

    Only suffixes whose rank is shared are sorted again; equal ranks of one level mean equal words, as no text holds
    the end marks that fill up short suffixes.
    """
    n = len(ids)
    levels = [ids]
    order = np.argsort(ids, kind="stable")
    width = 1
    while True:
        rank = levels[-1]
        ordered = rank[order]
        same = np.zeros(n + 1, dtype=bool)
        same[1:n] = ordered[1:] == ordered[:-1]
        shared = np.flatnonzero(same[:-1] | same[1:])
        if not len(shared):
            return levels
        at = order[shared]
        behind = at + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1).astype(np.int64)
        by = np.argsort((rank[at].astype(np.int64) << 32) + second + 1, kind="stable")
        at, first, second = at[by], rank[at][by], second[by]
        order[shared] = at
        # A rank is the place of the group's first suffix in the order.
        new = rank.copy()
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[at] = shared[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        levels.append(new)
        width *= 2


def _shared_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words are equal from the places ``a`` and ``b`` on, or before them."""
    n = len(levels[0])
    total = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        x, y = (a - total - width, b - total - width) if back else (a + total, b + total)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        equal = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        total += np.where(equal, width, 0)
    return total


def _nearest(values: np.ndarray, at: np.ndarray, before: bool, strict: bool) -> np.ndarray:
    """For each place of ``at`` the nearest place with a smaller (or, if not ``strict``, no larger) value.

    ``values`` starts and ends with a value below all others. Steps of 2**k over blocks whose minimum is too large.
    """
    tables = [values]
    reach = values > 0  # only stretches of positive values are crossed
    edges = np.flatnonzero(np.diff(np.concatenate(([0], reach.view(np.int8), [0]))))
    longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 1
    while 1 << len(tables) <= longest:
        last, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[:-half], last[half:]))
    own = values[at]
    place = at - 1 if before else at + 1  # the first place not yet known to be too large
    for k in range(len(tables) - 1, -1, -1):
        start = place - (1 << k) + 1 if before else place
        inside = (start >= 0) & (start < len(tables[k]))
        least = tables[k][np.where(inside, start, 0)]
        large = inside & ((least >= own) if strict else (least > own))
        place = np.where(large, place - (1 << k) if before else place + (1 << k), place)
    return place


def _squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that no further word extends."""
    rank = levels[-1]
    n = len(rank)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.full(n + 1, -1, dtype=np.int64)
    lcp[1:n] = _shared_words(levels, suffixes[:-1], suffixes[1:])
    split = np.flatnonzero(lcp > 0)
    if not len(split):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = lcp[split]
    low = _nearest(lcp, split, before=True, strict=True)
    high = _nearest(lcp, split, before=False, strict=True)
    # Children: one starts at each split, the first one of an interval at its left end.
    end = _nearest(lcp, split, before=False, strict=False)
    opening = lcp[_nearest(lcp, split, before=True, strict=False)] < depth
    starts = np.concatenate((split, low[opening]))
    ends = np.concatenate((end, split[opening]))
    lows, highs = np.concatenate((low, low[opening])), np.concatenate((high, high[opening]))
    depths = np.concatenate((depth, depth[opening]))
    # The largest child of an interval is left out; its pairs are met from the other side.
    order = np.lexsort((ends - starts, highs, lows))
    largest = np.ones(len(order), dtype=bool)
    largest[:-1] = (lows[order][1:] != lows[order][:-1]) | (highs[order][1:] != highs[order][:-1])
    kept = order[~largest]
    starts, ends, lows, highs, depths = (x[kept] for x in (starts, ends, lows, highs, depths))
    sizes = ends - starts
    child = np.repeat(np.arange(len(sizes)), sizes)
    member = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[child]
    here, step = suffixes[member], depths[child]
    found = []
    for there in (here + step, here - step):
        inside = (there >= 0) & (there < n)
        place = np.where(inside, rank[np.where(inside, there, 0)], -1)
        pair = (place >= lows[child]) & (place < highs[child]) & ((place < starts[child]) | (place >= ends[child]))
        found.append((np.minimum(here, there)[pair], step[pair]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def periodic_runs(texts: list[Words], options: RunOptions = OPTIONS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    if not first[-1]:
        return runs
    names: dict[tuple[int, str], int] = {}
    ids = np.fromiter((names.setdefault((k, w), len(names)) for k, words in enumerate(texts) for w in words), dtype=np.int64, count=first[-1])
    # A rank is the number of smaller suffixes, so that later levels can refine it in place.
    counts = np.bincount(ids)
    ids = (np.cumsum(counts) - counts)[ids].astype(np.int32)
    levels = _ranks(ids)
    start, period = _squares(levels)
    left = _shared_words(levels, start, start + period, back=True)
    end = start + 2 * period
    start = start - left
    long = end - start >= np.maximum(options.min_words, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), dtype=bool)  # a stretch that also has a multiple of its period comes once
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    text = np.searchsorted(first, start, side="right") - 1
    place = start - first[text]
    for i in np.lexsort((period, place, text)).tolist():
        runs[text[i]].append((int(place[i]), int(end[i] - start[i]), int(period[i])))
    return runs


def repeat_tail(doc_id: int | None, words: Words) -> Words:
    """``words``, for one doc_id in ten with a tail that repeats its first words."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def kept_words(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """``words`` without those that stand in a run after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _by_blocks(df: DataFrame, schema: str, rows_of: Callable[[int | None, Words, list], list[tuple]], options: RunOptions, change: Callable[[int | None, Words], Words] | None) -> DataFrame:
    """Runs of blocks of whole texts; ``rows_of`` (doc_id, words, runs) makes the rows after ``doc_id``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[tuple[int | None, Words]]) -> pa.RecordBatch:
            found = periodic_runs([w for _, w in held], options)
            rows = [(d, *row) for (d, w), r in zip(held, found, strict=True) for row in rows_of(d, w, r)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORDS.findall(text or "")
                held.append((doc_id, change(doc_id, words) if change else words))
                size += len(words)
                if size >= options.block_words:
                    yield block(held)
                    held, size = [], 0
            if held:
                yield block(held)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(source).mapInArrow(find, schema)


def find_runs(docs: DataFrame, options: RunOptions = OPTIONS) -> DataFrame:
    """Every run of every text: ``doc_id``, ``start`` (word number from 0), ``length``, ``period``.

    Rows as in ``run_report``; a text without runs has no row.
    """
    return _by_blocks(docs, "doc_id long, start long, length long, period long", lambda d, w, runs: runs, options, None)


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _report(doc_id: int | None, words: Words, runs: list[tuple[int, int, int]]) -> list[tuple]:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if runs else None
    return [(len(runs), *best, exponent, _sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), _sha(" ".join(kept_words(words, runs))))]


def run_report(docs: DataFrame, options: RunOptions = OPTIONS, change: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are not read): runs, the longest one, digests.

    ``change`` (doc_id, words) may alter the words first. A null, empty or blank text has no words, no run, and digests of
    the empty text. Repeated rows and null ids are judged like any other row. An empty table gives no rows. Texts are
    read whole: time n log n, memory about 200 bytes a word of the longest text. Row by row, no shuffle.
    """
    return _by_blocks(docs, REPORT, _report, options, change)
