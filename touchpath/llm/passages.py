"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are kept: in every window of ``window`` consecutive word starts the one whose
n-gram hash is smallest. Copies of a passage select the same places, so every passage of ``min_words`` words has one kept
suffix that is selected among its first ``window`` starts, with at least ``key_words`` words to go, and equal passages have
equal suffixes at equal offsets. Suffixes that share their first ``key_words`` words meet. Each is then extended to the left and
to the right as far as the passages go that selected it: its stretch. Equal stretches repeat as a whole. Of the suffixes
whose stretch stands alone, and of one suffix of each equal stretch with the same first words, the passages are compared one
by one, so that left and right extension always are those of one and the same other place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchpath.llm.common import text_batches
from touchpath.session import cut_lineage


@dataclass(frozen=True)
class PassageOptions:
    min_words: int = 50
    window: int = 16
    gram: int = 8

    @property
    def key_words(self) -> int:
        return self.min_words - self.window + 1


OPTIONS = PassageOptions()
_ODD = np.random.default_rng(7).integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _FOLD)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _FOLD)


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of any stretches of a text's words, from sums of word hashes times powers of an odd number."""

    def __init__(self, hashes: np.ndarray, base: np.uint64) -> None:
        n = len(hashes)
        self.back = np.cumprod(np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)) * base  # powers of the inverse, from 0
        powers = np.cumprod(np.full(n, base, np.uint64))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers, dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``start`` up to ``end``."""
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _ODD[1000]).view(np.int64)


def selected(hashes: np.ndarray, options: PassageOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept suffixes, in order, and the first and last start of the passages that selected each."""
    n = len(hashes)
    if n < options.min_words:
        return (np.empty(0, np.int64),) * 3
    grams = np.zeros(n - options.min_words + options.window, np.uint64)
    for i in range(options.gram):
        grams += hashes[i : i + len(grams)] * _ODD[i]
    windows = np.lib.stride_tricks.sliding_window_view(_mixed(grams), options.window)
    places = np.arange(len(windows)) + windows.argmin(axis=1)
    changes = np.flatnonzero(places[1:] != places[:-1])
    return places[np.concatenate(([0], changes + 1))], np.concatenate(([0], changes + 1)), np.concatenate((changes, [len(places) - 1]))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


#: ``reach`` packs the first start of a suffix's passages and how many follow it, fewer than ``window``.
_KEPT = ["key", "stretch", "reach"]


def _suffixes(docs: DataFrame, options: PassageOptions) -> DataFrame:
    """One row per document with its kept suffixes, stored: ``row``, ``doc_id``, ``text_hash`` and lists of ``_KEPT``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list[np.ndarray]] = [[], [], []]
            for text in batch.column(2).to_pylist():
                hashes = word_hashes(text)
                at, low, high = selected(hashes, options)
                key = Rolling(hashes, _ODD[1001]).of(at, at + options.key_words) if len(at) else at
                stretch = Rolling(hashes, _ODD[1002]).of(low, high + options.min_words) if len(at) else at
                for column, values in zip(lists, (key, stretch, low * options.window + high - low), strict=True):
                    column.append(values)
            ends = pa.array(np.cumsum([0, *map(len, lists[0])], dtype=np.int32))
            arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *x]))) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "text_hash", *_KEPT])

    schema = "doc_id long, text_hash long, key array<long>, stretch array<long>, reach array<long>"
    done = text_batches(_hashed(docs)).mapInArrow(work, schema)
    return cut_lineage(done.where(F.size("key") > 0).withColumn("row", F.monotonically_increasing_id()))


def _passages(docs: DataFrame, rows: DataFrame, needed: DataFrame, options: PassageOptions) -> DataFrame:
    """Every passage of the suffixes ``needed`` (``row``, ``reach``, ``copies``, ``first_doc_id``) with its two hashes, stored."""
    names = ["hash1", "hash2", "row", "start", "copies", "first_doc_id"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = word_hashes(text)
                reach = [divmod(w["reach"], options.window) for w in wanted]
                sizes = [more + 1 for _, more in reach]
                start = np.concatenate([np.arange(low, low + more + 1) for low, more in reach])
                both = [Rolling(hashes, base).of(start, start + options.min_words) for base in _ODD[1003:1005]]
                own = np.repeat(np.arange(len(wanted)), sizes)
                copies = np.array([w["copies"] for w in wanted], np.int64)[own]
                first = pa.array([w["first_doc_id"] for w in wanted], pa.int64()).take(pa.array(own))
                columns = [*both, np.full(len(start), row, np.int64), start, copies]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types[:-1], strict=True)), first], names)

    wanted = needed.groupBy("row").agg(F.collect_list(F.struct("reach", "copies", "first_doc_id")).alias("wanted"))
    wanted = wanted.join(rows.select("row", F.coalesce("doc_id", F.lit(-1)).alias("_id"), "text_hash"), "row")
    texts = _hashed(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), "text_hash", "text").dropDuplicates(["_id", "text_hash"])
    joined = texts.join(wanted, ["_id", "text_hash"]).select("row", "text", "wanted")
    return cut_lineage(text_batches(joined).mapInArrow(work, "hash1 long, hash2 long, row long, start int, copies long, first_doc_id long"))


def repeated_passages(docs: DataFrame, options: PassageOptions = OPTIONS) -> DataFrame:
    """One row per repeated span: ``doc_id``, ``start_word``, ``n_words``, ``first_doc_id``, ``copies``, ``is_first``.

    Reads ``doc_id`` and ``text``; words are cut at ASCII white space and compared by hashes of 128 bits. A span is a union of
    passages of ``min_words`` words each of which stands twice in the table, in two rows or in one, and every such passage
    lies within a span of each row it stands in. ``first_doc_id`` is the smallest id that shares a passage of it, ``copies`` the
    largest number of copies found, and ``is_first`` says that no passage of it stands in a document with a smaller id.
    Null, empty and shorter texts have no rows; equal rows are copies of each other; a null id is reported as null and is
    never the first; an empty table gives no rows.
    """
    rows = _suffixes(docs, options)
    suffixes = rows.select("row", "doc_id", F.explode(F.arrays_zip(*_KEPT)).alias("at")).select("row", "doc_id", "at.*")
    again = cut_lineage(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    found = cut_lineage(suffixes.join(again, "key"))
    # One of each equal stretch stands for all; alone it may still share passages with others of its key.
    one = F.min(F.struct("row", "reach")).alias("one")
    groups = cut_lineage(found.groupBy("key", "stretch").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"), one))
    open_keys = cut_lineage(groups.where("copies = 1").select("key").distinct())
    needed = groups.join(open_keys, "key", "left_semi").select("one.*", "copies", "first_doc_id")
    passages = _passages(docs, rows, needed, options)
    shared = passages.groupBy("hash1", "hash2").agg(F.sum("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id")).where("copies > 1")
    alone = passages.where("copies = 1").select("hash1", "hash2", "row", F.col("first_doc_id").alias("doc_id"), "start")
    words = F.lit(options.min_words)
    pieces = alone.join(cut_lineage(shared), ["hash1", "hash2"]).select("row", "doc_id", F.col("start"), (F.col("start") + words).alias("end"), "copies", "first_doc_id")
    whole = found.join(groups.where("copies > 1").drop("one"), ["key", "stretch"])
    low, more = F.expr(f"cast(reach div {options.window} as int)"), F.expr(f"cast(reach % {options.window} as int)")
    pieces = pieces.unionByName(whole.select("row", "doc_id", low.alias("start"), (low + more + words).alias("end"), "copies", "first_doc_id"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > reach, F.lit(True))
    spans = pieces.withColumn("opens", opens).withColumn("span", F.count_if("opens").over(order)).groupBy("row", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start_word"), F.max("end").alias("end_word"),
        F.max("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id"),
    )
    is_first = F.coalesce(F.col("doc_id") <= F.col("first_doc_id"), F.lit(False))
    length = (F.col("end_word") - F.col("start_word")).alias("n_words")
    return spans.select("doc_id", "start_word", length, "first_doc_id", "copies", is_first.alias("is_first"))
