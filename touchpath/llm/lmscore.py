"""Scores of texts by a causal self-attention model over subword ids, beside word counts as their base.

The model's text is the words of the text, A-Z in lower case, each after one space, and an end. Texts are encoded once.

All of it is learned from all training texts: word counts (base), counts of subword ids and of pairs of their classes, and
the attention, trained on every window of every training text once. Training runs in the tasks: a round takes its share of
the windows of each text, every task trains on them from the common parameters, and the tasks' parameters are averaged,
weighted by windows, in a Spark aggregation. Windows are cut from the stored ids when their round comes; they are not stored.
What reaches the driver is bounded: ids of the vocabulary, pairs of classes, parameters.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpath.llm import attention
from touchpath.llm.attention import AttentionOptions, Pairs, Params
from touchpath.llm.common import text_batches
from touchpath.session import cut_lineage, stored

#: Closes every text; the vocabulary's special token, which no text encodes to.
END_ID = 50_256
VOCABULARY = 50_257
#: Words of which a task that remembers more forgets them all, between portions.
KEPT_WORDS = 300_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words of texts whose ids are put together at a time.
SPELLED_WORDS = 262_144
#: A word with a share of at least 1/HOT of all tokens is looked up in every task; there are at most HOT of them.
HOT = 131_072
#: Training windows that a task cuts from its texts at a time.
HELD_WINDOWS = 8_192


@dataclass(frozen=True)
class TokenClasses:
    """The class of every subword id, and the log probability of the id within its class."""

    of: np.ndarray
    within: np.ndarray


class Numbers:
    """Numbers of words from 0 on, by their first use."""

    def __init__(self) -> None:
        self.of: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)

    def __len__(self) -> int:
        return len(self.of)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.int32, len(words))

    def since(self, known: int) -> list[bytes]:
        """The words with numbers of ``known`` and more."""
        return list(islice(reversed(self.of), len(self.of) - known))[::-1]


class Subwords:
    """Subword ids of words; ``vocabulary`` names a file of ranks, None takes the installed multilingual 50k one.

    Every word is a piece with the space before it, whatever characters it holds, so its ids do not depend on its
    neighbours: the words that are new in a batch are encoded together, once, and remembered until ``forget``.
    """

    def __init__(self, vocabulary: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(VOCABULARY, dtype=bool)
        self.opens[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.forget()

    def forget(self) -> None:
        """Remember no word; the end is number 0, as the empty word."""
        self.known = Numbers()
        self.known.of_words([b""])
        self.pool, self.starts, self.lengths = np.array([END_ID], "<u2"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def numbered(self, texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The number of every word of ``texts`` and, after each text, of its end; how many each text has; and the new words.

        A text's words are looked up as it comes, while they are in the processor's cache.
        """
        known = len(self.known)
        found = [self.known.of_words([*words, b""]) for words in texts]
        numbers, sizes = np.concatenate(found), np.array([*map(len, found)], np.int64)
        if new := self.known.since(known):
            ids = self.encoding.encode_to_numpy(b" ".join([b"", *new]).decode(), disallowed_special=())
            first = np.flatnonzero(self.opens[ids])  # an id that starts with a space starts a word
            self.starts = np.concatenate((self.starts, len(self.pool) + first))
            self.lengths = np.concatenate((self.lengths, np.diff(first, append=len(ids))))
            self.pool = np.concatenate((self.pool, ids.astype("<u2")))
        return numbers, sizes, new

    def spelled(self, numbers: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Ids (little-endian unsigned 16-bit) of texts, given as ``numbers`` of their words, of which each has ``sizes``."""
        parts = []
        for at in range(0, len(numbers), SPELLED_WORDS):
            part = numbers[at : at + SPELLED_WORDS]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            parts.append(self.pool[np.arange(ends[-1]) + np.repeat(self.starts[part] - ends + lengths, lengths)].tobytes())
        data = b"".join(parts)
        cuts = 2 * np.cumsum(np.add.reduceat(self.lengths[numbers], np.cumsum(sizes) - sizes))
        return [data[lo:hi] for lo, hi in pairwise([0, *cuts.tolist()])]

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of each text's words, closed by ``END_ID``."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        return self.spelled(*self.numbered(texts)[:2]) if texts else []


@dataclass(frozen=True)
class Model:
    """Everything that a score needs; its size does not depend on the corpus."""

    classes: TokenClasses
    pairs: Pairs
    params: Params
    options: AttentionOptions


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _words(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case; ``bytes`` cuts and lowers in ASCII alone."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``c`` over the texts of ``docs`` (``text``); the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "c"])
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(_words(text))
                found[b""] += 1
            if len(found) > HELD_WORDS:
                yield counted()
        yield counted()

    parts = text_batches(docs.select("text")).mapInArrow(count, "word string, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def _encoded(docs: DataFrame, training: Column, hot: dict[bytes, float]) -> DataFrame:
    """Every row of ``docs`` under ``portion`` and ``place``, stored: subword ``ids``, ``n_tokens``, and of its base the part of
    the ``hot`` words (``known``, ``total``).

    A portion is a stretch of one task's rows with about ``HELD_WORDS`` other words. It ends with a row of place -1 that holds
    those ``words``, each once, which of them its texts use in turn (``uses``), and how many each text (``sizes``).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, common = Subwords(), shared.value
        portion, words, uses, sizes, spellings = TaskContext.get().partitionId() << 32, [], [], [], [b""]

        def values_of(new: list[bytes]) -> np.ndarray:
            """The hot words' part of the base by number, -1 for the others."""
            return np.fromiter((common.get(w, -1.0) for w in new), np.float64, len(new))

        def batch_of(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def closed() -> pa.RecordBatch:
            used = np.concatenate([np.empty(0, "<i4"), *uses]).astype("<i4").tobytes()
            return batch_of([[portion], [-1], *[[None]] * 6, [[w.decode() for w in words]], [used], [np.concatenate(sizes)]])

        value = values_of(spellings)
        place = np.full(1, -1, "<i4")  # of a number among the portion's other words
        for batch in batches:
            if not len(batch):
                continue
            numbers, n, new = subwords.numbered(map(_words, batch.column(1).to_pylist()))
            spellings += new
            value = np.concatenate((value, values_of(new)))
            place = np.concatenate((place, np.full(len(new), -1, "<i4")))
            owner, part = np.repeat(np.arange(len(n), dtype=np.int32), n), value[numbers]
            is_hot, is_other = part >= 0, (part < 0) & (numbers > 0)
            known = np.bincount(owner[is_hot], minlength=len(n))
            total = np.bincount(owner[is_hot], part[is_hot], len(n))
            others = numbers[is_other]
            first = np.unique(others[place[others] < 0])
            place[first] = np.arange(len(words), len(words) + len(first))
            words += map(spellings.__getitem__, first.tolist())
            uses.append(place[others])
            at = sum(map(len, sizes))
            sizes.append(np.bincount(owner[is_other], minlength=len(n)).astype(np.int32))
            nothing = [None] * len(n)
            ids = subwords.spelled(numbers, n)
            yield batch_of([np.full(len(n), portion), np.arange(at, at + len(n), dtype=np.int32), batch.column(0), batch.column(2), n, known, total, ids, nothing, nothing, nothing])
            if len(words) >= HELD_WORDS:
                yield closed()
                portion += 1
                words, uses, sizes = [], [], []
                place[:] = -1
                if len(spellings) > KEPT_WORDS:
                    subwords.forget()
                    spellings = [b""]
                    value, place = value[:1], place[:1]
        if sizes:
            yield closed()

    shared = docs.sparkSession.sparkContext.broadcast(hot)
    schema = (
        "portion long, place int, doc_id long, training boolean, n_tokens long, known long, total double, ids binary, "
        "words array<string>, uses binary, sizes array<int>"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32())]
    return stored(text_batches(_source(docs).withColumn("training", training)).mapInArrow(encode, schema), "lm-tokens")


def _rare_parts(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """``portion``, ``place``, ``rare_known``, ``rare_total`` of every text: its other words, by their ``counts``.

    Only a portion's distinct words move; their counts come back as one list for each portion.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            portions, uses, sizes = (batch.column(i).to_pylist() for i in range(3))
            found = batch.column(3)
            pos, c = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            ends = found.offsets.to_numpy()
            for i, portion in enumerate(portions):
                used, n = np.frombuffer(uses[i], "<i4"), len(sizes[i])
                value = np.zeros(int(used.max(initial=-1)) + 1)
                value[pos[ends[i] : ends[i + 1]]] = np.log10(c[ends[i] : ends[i + 1]].astype(np.float64) + 1)
                owner = np.repeat(np.arange(n), sizes[i])
                known = np.bincount(owner, value[used] > 0, n).astype(np.int64)
                total = np.bincount(owner, value[used], n).astype(np.float64)
                columns = [np.full(n, portion), np.arange(n, dtype=np.int32), known, total]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["portion", "place", "rare_known", "rare_total"])

    ends = encoded.where("place < 0")
    words = ends.select("portion", F.posexplode("words").alias("pos", "word"))
    found = words.join(counts, "word").groupBy("portion").agg(F.collect_list(F.struct("pos", "c")).alias("found"))
    none = F.array().cast("array<struct<pos: int, c: bigint>>")
    rows = ends.select("portion", "uses", "sizes").join(found, "portion", "left")
    rows = rows.select("portion", "uses", "sizes", F.coalesce("found", none).alias("found"))
    return text_batches(rows).mapInArrow(add, "portion long, place int, rare_known long, rare_total double")


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def _id_counts(encoded: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.concatenate([np.zeros(0, np.uint16), *_texts(batch.column(0))]), minlength=VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = text_batches(encoded.select("ids")).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


def token_classes(counts: np.ndarray, options: AttentionOptions) -> TokenClasses:
    """The end and the most frequent ids have a class each; the others share classes of about equal weight, by frequency."""
    weight = counts + 1.0
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = np.concatenate(([END_ID], order[order != END_ID]))
    of = np.empty(len(counts), dtype=np.int64)
    single, shared = order[: options.single], order[options.single :]
    of[single] = np.arange(len(single))
    tail = np.cumsum(weight[shared])
    of[shared] = len(single) + np.minimum((tail - weight[shared]) / tail[-1] * (options.classes - len(single)), options.classes - len(single) - 1).astype(np.int64)
    total = np.bincount(of, weight, minlength=options.classes)
    return TokenClasses(of.astype(np.int16 if options.classes < 1 << 15 else np.int64), np.log(weight / total[of]))


def _rounds(doc_ids: list[int | None], counts: np.ndarray, options: AttentionOptions) -> np.ndarray:
    """Round of each window of texts that have ``counts``, by hash, so the same in every run; -1 for none, where ``every`` is not 1."""
    seeds = np.array([zlib.crc32(b"" if d is None else str(d).encode()) for d in doc_ids], np.uint64)
    x = np.arange(counts.sum(), dtype=np.uint64) + np.repeat((seeds << np.uint64(24)) - (np.cumsum(counts) - counts).astype(np.uint64), counts)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.where(x % np.uint64(options.every) == 0, (x // np.uint64(options.every)) % np.uint64(options.rounds), -1).astype(np.int64)


def _pair_counts(encoded: DataFrame, classes: TokenClasses, options: AttentionOptions) -> np.ndarray:
    """Counts of pairs of classes over all texts."""
    size = options.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            of = classes.of[np.concatenate([np.zeros(0, np.uint16), *_texts(batch.column(0))])].astype(np.int64)
            pairs += np.bincount(np.concatenate((of[-1:], of[:-1])) * size + of, minlength=size * size)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(pairs[at])], ["code", "n"])

    found = text_batches(encoded.select("ids")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size * size, dtype=np.int64)
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    return counts


def _windows_of(batch: pa.RecordBatch, number: int, classes: TokenClasses, options: AttentionOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of the windows that round ``number`` takes of the texts of ``batch``, ``HELD_WINDOWS`` at a time, mixed."""
    texts = _texts(batch.column(1))
    if not texts:
        return
    of, ends = classes.of[np.concatenate(texts)], np.cumsum([len(t) for t in texts])
    rounds = _rounds(batch.column(0).to_pylist(), attention.window_counts(ends, options), options)
    chosen = np.random.default_rng(number).permutation(np.flatnonzero(rounds == number))
    for at in range(0, len(chosen), HELD_WINDOWS):
        inputs, scored, _ = attention.windows(of, ends, options, chosen[at : at + HELD_WINDOWS])
        yield inputs, np.where(scored >= 0, of[np.maximum(scored, 0)], -1)


def _trained(encoded: DataFrame, classes: TokenClasses, pairs: Pairs, options: AttentionOptions) -> Params:
    """Parameters after all rounds; in a round every task starts from the same parameters, and the results are averaged."""
    params = attention.initial(options)

    def round_of(number: int, params: Params) -> np.ndarray:
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                inputs, targets = np.zeros((0, options.places), np.int16), np.zeros((0, options.stride), classes.of.dtype)
                for batch in batches:
                    for more in _windows_of(batch, number, classes, options):
                        inputs, targets = (np.concatenate(x) for x in zip((inputs, targets), more, strict=True))
                        whole = len(inputs) // options.batch * options.batch
                        for at in range(0, whole, options.batch):
                            yield inputs[at : at + options.batch], targets[at : at + options.batch]
                        inputs, targets = inputs[whole:], targets[whole:]
                if len(inputs):
                    yield inputs, targets

            after, seen = attention.train_locally(params, pairs, steps(), options.rate / (1 + number), options)
            values = np.concatenate((attention.flat(after).astype(np.float64), [1.0])) * seen if seen else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

        rows = text_batches(encoded.select("doc_id", "ids"))
        sums = rows.mapInArrow(train, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        values = np.zeros(len(sums))
        values[sums["i"].to_numpy()] = sums["v"].to_numpy()
        return values

    for number in range(options.rounds):
        values = round_of(number, params)
        if len(values):
            params = attention.shaped(values[:-1] / values[-1], params)
    return params


def train(encoded: DataFrame, options: AttentionOptions = attention.OPTIONS) -> Model:
    """The model of the texts of ``encoded`` (``doc_id``, ``ids``); without any row it is the untrained model."""
    classes = token_classes(_id_counts(encoded), options)
    pairs = attention.pair_logits(_pair_counts(encoded, classes, options), options)
    return Model(classes, pairs, _trained(encoded, classes, pairs, options), options)


def log10_of(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each of ``texts``, given as ids that end with ``END_ID``."""
    ids, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    of = model.classes.of[ids]
    each = attention.class_scores(model.params, model.pairs, of, ends, model.options) + model.classes.within[ids]
    return np.add.reduceat(each, np.concatenate(([0], ends[:-1]))) / np.log(10)


def _scored(encoded: DataFrame, model: Model) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(batch.num_columns - 1))
            parts = [log10_of(model, texts[i : i + 100]) for i in range(0, len(texts), 100)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0), *parts]))], names)

    rows = text_batches(encoded.select("portion", "place", "doc_id", "n_tokens", "known", "total", "ids"))
    names = [*rows.columns[:-1], "score"]
    return rows.mapInArrow(judge, "portion long, place int, doc_id long, n_tokens long, known long, total double, score double")


def language_scores(docs: DataFrame, training: Column, options: AttentionOptions = attention.OPTIONS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row of ``docs``.

    The model and the counts learn from the rows for which ``training`` (over ``doc_id``) holds. Null and empty texts are the
    end token alone. Repeated rows and null ids are scored like any other row, columns but ``doc_id`` and ``text`` are not
    read, texts of any length are scored whole. Without training rows every token has base probability 1, as the
    formula says, and the model is untrained. An empty table gives no rows.

    The end and words with at least 1/``HOT`` of all tokens are summed where texts are encoded; the others meet their counts in
    a join, once for each portion of the texts, so no word brings more than one row a portion.
    """
    counts = cut_lineage(word_counts(_source(docs).where(training)))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, base = totals["n"], float(np.log10(totals["n"] + totals["v"] + 1))
    hot = {r["word"].encode(): float(np.log10(r["c"] + 1)) for r in counts.where((F.col("c") * HOT >= n) | (F.col("word") == "")).collect()}
    encoded = _encoded(docs, training, hot)
    model = train(encoded.where("training").select("doc_id", "ids"), options)
    found = _rare_parts(encoded, counts.where(F.col("c") * HOT < n))
    whole = _scored(encoded.where("place >= 0"), model).join(found, ["portion", "place"], "left")
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("rare_total", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        "score",
    )
