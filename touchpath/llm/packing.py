"""Best-fit packing of token sequences: minimum bin slack.

The fullest feasible combination for a bin depends on the lengths that are left, not on which pieces have them. So the
bins are planned on the histogram of lengths (at most ``capacity`` numbers): the longest length left opens a bin, a
bitset of reachable sums finds the fullest filling, and the combination is removed as often as the histogram allows,
which is what filling equal bins one by one would do. The pieces then look up their place by (length, rank).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import text_batches
from touchpath.llm.prefix import running_total, uniform_key
from touchpath.session import cut_lineage


@dataclass(frozen=True)
class PackOptions:
    """``vocabulary`` names a byte-level BPE vocabulary file of ranks; None takes the installed 50k one.

    ``end_id`` closes every document.
    """

    capacity: int = 2048
    vocabulary: str | None = None
    end_id: int = 0


OPTIONS = PackOptions()
#: Fixed values of the vocabulary: its one special token, an id of its own where it stands in a text.
SPECIAL = {"<|endoftext|>": 50256}
#: White space as the vocabulary's pattern knows it, in runs that its matcher, which backtracks, could not hold.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


@lru_cache(maxsize=1)
def encoder(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids, loaded once per Python worker.

    The ids are those of ``tokenizers`` with ``byte_bpe_50k.json``; the same vocabulary as ranks gives them
    several times faster.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        """A long run of white space is cut where the pattern cuts: its last character goes with what follows."""
        ids, start = [], 0
        for run in _LONG_BLANK.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += encoding.encode(text[start : run.start()], allowed_special="all")
            ids += _blank_ids(encoding, text[run.start() : end])
            start = end
        return ids + encoding.encode(text[start:], allowed_special="all")

    return encode


def _blank_ids(encoding, run: str) -> list[int]:
    """Ids of one piece of white space, without the pattern."""
    return encoding._encode_single_piece(run)


def token_pieces(docs: DataFrame, options: PackOptions = OPTIONS, narrow: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit) of all pieces of all texts.

    A document's ids end with ``end_id``, so a null or empty text is that one id. Only documents longer than
    ``capacity`` are cut: full pieces, the shorter rest first. Repeated rows and null ids give pieces like any other row.
    With ``narrow``, pieces whose ids all fit have 16 bits an id, which ``pack`` widens again: half to store and to move.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(options.vocabulary)
        size = options.capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), options.end_id], dtype="<u4")
                stored = ids.astype("<u2") if narrow and ids.max() < 1 << 16 else ids
                ends = range(len(ids) % size or size, len(ids) + 1, size) if len(ids) >= size else [len(ids)]
                start = 0
                for piece, end in enumerate(ends):
                    rows.append((doc_id, piece, start, end - start, stored[start:end].tobytes()))
                    start = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(source).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths within ``counts`` with the largest sum up to ``room``.

    Bit s of ``reached`` says that sum s can be made. Longer lengths come first, and a length enters in lots of 1, 2, 4, ...
    so that few shifts cover any count. Ties prefer longer, so fewer, lengths.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left > 0:
            lot = min(lot, left)
            steps.append((length, lot, reached))
            reached |= (reached << (length * lot)) & mask
            left, lot = left - lot, 2 * lot
        if reached >> room & 1:
            break
    best = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, lot, before in reversed(steps):
        if not before >> best & 1:
            best -= length * lot
            chosen[length] = chosen.get(length, 0) + lot
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, their lengths with multiplicity), until nothing is left of ``histogram``."""
    left = {length: n for length, n in histogram.items() if n > 0}
    bins = []
    while left:
        seed = max(left)
        rest = {**left, seed: left[seed] - 1}
        bin_ = fullest(capacity - seed, {k: n for k, n in rest.items() if n})
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        bins.append((times, bin_))
    return bins


def _places(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """(length, first rank, per bin, first sequence, offset in the sequence) of every length in every kind of bin."""
    rows, used, sequence = [], {}, 0
    for times, bin_ in bins:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _widened(ids: pa.Array, length: np.ndarray) -> pa.Array:
    """``ids`` with 32 bits an id, whichever rows have 16."""
    rows = zip(ids.to_pylist(), length.tolist(), strict=True)
    return pa.array([np.frombuffer(x, "<u2").astype("<u4").tobytes() if x is not None and len(x) == 2 * n else x for x, n in rows], pa.binary())


def pack(pieces: DataFrame, options: PackOptions = OPTIONS) -> DataFrame:
    """``pieces`` (``length``, ``doc_id``, ``piece``, any others) with ``sequence_id`` and ``offset``.

    No sequence is longer than ``capacity``; offsets leave no gap; sequences are numbered from 0. ``pieces`` is stored
    first, since its histogram and its rows must be of one run. Pieces of one length are told apart by a hash of
    their place in the stored table, so no id, null or repeated, gathers rows; which of them goes where is open. A
    length above ``capacity`` or below 1 is an error; an empty table gives no rows. Only the histogram (``capacity``
    rows at most) meets on the driver, and goes to every task, so that the rows move once. Binary ``ids`` of 16 bits
    come out with 32.
    """
    stored = cut_lineage(pieces.withColumn("_key", uniform_key(F.monotonically_increasing_id())))
    counts = cut_lineage(stored.groupBy("length").agg(F.count("*").alias("n")))
    if counts.where(~F.col("length").between(1, options.capacity) | F.col("length").isNull()).count():
        raise ValueError("a piece must have 1 to capacity tokens")
    places = _places(plan_bins({r["length"]: r["n"] for r in counts.collect()}, options.capacity))
    ranked = running_total(stored.withColumn("_one", F.lit(1).cast("long")), F.broadcast(counts), ["length"], "_key", ["doc_id", "piece"], "_one", "_rank")
    span = np.int64(1 << 44)  # ranks of one length are below
    starts = places[:, 0] * span + places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = places[np.searchsorted(starts, length * span + rank, side="right") - 1]
            bin_, slot = np.divmod(rank - at[:, 1], at[:, 2])
            kept = [c for c in batch.schema.names if c != "_rank"]
            arrays = [_widened(a, length) if c in wide else a for c, a in ((c, batch.column(batch.schema.get_field_index(c))) for c in kept)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(at[:, 3] + bin_), pa.array(at[:, 4] + slot * length)], [*kept, "sequence_id", "offset"])

    ranked = ranked.drop("_key", "_one")
    wide = {f.name for f in ranked.schema.fields if f.name == "ids" and f.dataType.simpleString() == "binary"}
    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return text_batches(ranked).mapInArrow(place, f"{schema}, sequence_id long, offset long")
