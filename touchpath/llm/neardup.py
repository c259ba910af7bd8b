"""MinHash near-duplicates: fast similarity sketching, banding and exact verification.

Every document's set of word shingles is thrown into the coordinates of its sketch, round after round with another
hash, until each coordinate holds the first and smallest arrival (after as many rounds as there are coordinates, each round
serves one coordinate, so all fill). Equal bands of coordinates make candidates. Links are confirmed on full sets.

Documents with equal sets form one node. Within a band's bucket no pair list is made: first every node is
compared with one smallest node of its buckets, which joins groups of copies; then only buckets whose nodes are not yet
connected are compared in full, in bounded blocks that give no more links than connect them. The nodes of larger open
buckets first meet by their rare shingles: two similar sets share one of the rarest of each, so nodes that have only
a frequent phrase in common are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import fresh, stored_in_batches, text_batches
from touchpath.llm.components import components
from touchpath.session import cut_lineage


@dataclass(frozen=True)
class NearDupOptions:
    """A pair at the similarity limit of 75 % shares none of 48 bands of 5 coordinates with probability 2.3e-6.

    A block, which one task compares as a whole, has about ``block`` shingles and ``block_sets`` sets at most. Nodes of
    buckets of more than ``most_blocks`` blocks meet by rare shingles instead.
    """

    words: int = 5
    percent: int = 75
    bands: int = 48
    rows: int = 5
    block: int = 262_144
    block_sets: int = 1_024
    most_blocks: int = 4


OPTIONS = NearDupOptions()
_ODD = np.random.default_rng(5).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = [np.uint64(x) for x in (33, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 32, 0xFFFFFFFF, 42)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U[0])) * _U[1]
    x = (x ^ (x >> _U[0])) * _U[2]
    return x ^ (x >> _U[0])


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words count as one shingle, no words as none."""
    tokens = (text or b"").lower().split()  # ASCII letters and ASCII white space only
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    if n < words:
        return _mixed((hashes * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
    size = n - words + 1
    total = np.zeros(size, np.uint64)
    for i in range(words):
        total += hashes[i : i + size] * _ODD[i]
    return np.unique(_mixed(total))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a set that is not empty: round and hash of the item that got there first."""
    filled = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    n, i = len(items), 0
    while empty.any():
        if i < t:
            rounds = np.arange(i, min(t, i + max(1, 3 * t // (2 * n))), dtype=np.uint64)
            hashes = _mixed(items[None, :] ^ _ODD[100 + rounds.astype(np.int64)][:, None])
            bins = ((hashes >> _U[3]) * np.uint64(t)) >> _U[3]
            keys = ((bins << _U[5]) | (rounds[:, None] << _U[3]) | (hashes & _U[4])).ravel()
            keys.sort()
            at = (keys >> _U[5]).astype(np.int64)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            first = first[empty[at[first]]]
            filled[at[first]] = keys[first] & ((np.uint64(1) << _U[5]) - np.uint64(1))
            empty[at[first]] = False
            i += len(rounds)
        else:
            for place in np.flatnonzero(empty):
                least = (_mixed(items ^ _ODD[100 + t + place]) & _U[4]).min()
                filled[place] = (np.uint64(t + place) << _U[3]) | least
            empty[:] = False
    return filled


def band_keys(coordinates: np.ndarray, options: NearDupOptions) -> np.ndarray:
    grid = coordinates.reshape(options.bands, options.rows)
    return _mixed((grid * _ODD[2000 : 2000 + options.rows]).sum(axis=1) + np.arange(options.bands, dtype=np.uint64) * _ODD[2100]).view(np.int64)


def _sketched(docs: DataFrame, options: NearDupOptions) -> DataFrame:
    """``uid``, ``doc_id``, ``text_hash``, ``n_shingles``, set fingerprint (``fp1``, ``fp2``) and band ``keys``, stored."""
    names = ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "keys"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, keys = [], [], []
            for text in batch.column(2).to_pylist():
                items = shingles(text, options.words)
                n.append(len(items))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64))
                if len(items):
                    keys.append(band_keys(sketch(items, options.bands * options.rows), options))
                else:
                    keys.append(np.empty(0, np.int64))
            fp = np.array(prints).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), lists], names)

    source = _hashed(docs).select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    done = text_batches(source).mapInArrow(work, "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, keys array<long>")
    return cut_lineage(done.withColumn("uid", F.monotonically_increasing_id()))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, options: NearDupOptions) -> DataFrame:
    """``node`` and its full set (``items``) for the rows ``wanted`` (``doc_id``, ``text_hash``, ``node``), stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, options.words).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "items"])

    keys = ["_id", "text_hash"]
    known = F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id")  # only to find the row again
    rows = _hashed(docs).select(known, "text_hash", "text").join(wanted.select(known, "text_hash", "node"), keys)
    rows = rows.groupBy(*keys, "node").agg(F.first("text").alias("text"))
    texts = rows.select("node", F.col("text").cast("binary").alias("text"))
    return cut_lineage(text_batches(texts).mapInArrow(work, "node long, items binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(p), len(q)))
                shared = 0
                if 100 * small >= percent * large:
                    both = np.sort(np.concatenate([p, q]))
                    shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "items": "left"}), "a").join(sets.withColumnsRenamed({"node": "b", "items": "right"}), "b")
    return cut_lineage(text_batches(joined.select("a", "b", "left", "right")).mapInArrow(work, "a long, b long"))


def _forest(nodes: np.ndarray, groups: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what can be connected of a block, found by exact comparison of all its open pairs."""
    sizes = np.array([len(s) for s in sets])
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = counts[number] > 1  # a shingle of one set alone is in no intersection
    owner, number = owner[common], np.unique(number[common], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    width = 2048
    for start in range(0, int(number.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(number, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], number[lo:hi] - start] = 1
        shared += part @ part.T
    similar = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    similar &= groups[:, None] != groups[None, :]
    if across:
        similar &= blocks[:, None] != blocks[None, :]
    root = {g: g for g in groups.tolist()}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    links = []
    for x, y in zip(*np.nonzero(np.triu(similar)), strict=True):
        p, q = find(int(groups[x])), find(int(groups[y]))
        if p != q:
            root[p] = q
            links.append((int(nodes[x]), int(nodes[y])))
    return links


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key``, ``node``, ``component``: the ``nodes`` under each of their rare shingles.

    A set x that is similar to y shares at least ceil(percent of its size) shingles with it. So whatever order the
    shingles have, both have one of their first ``size - ceil(...) + 1`` in common; by rarity, those keys are small.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in items])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([np.empty(0, np.int64), *items]))], ["node", "key"])

    found = cut_lineage(text_batches(sets.join(nodes.select("node"), "node", "left_semi")).mapInArrow(spread, "node long, key long"))
    frequent = found.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    sizes = found.groupBy("node").agg(F.count("*").alias("size"))
    shared = found.join(frequent, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    # Shingles of one set alone come before all others, and lead nowhere.
    first = F.expr(f"cast(size - (size * {percent} + 99) div 100 + 1 - (size - size(keys)) as int)")
    keys = shared.join(sizes, "node").withColumn("first", first).where("first > 0")
    keys = keys.select("node", F.explode(F.expr("slice(keys, 1, first).key")).alias("key"))
    return keys.join(nodes, "node").select("key", "node", "component")


def _open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, options: NearDupOptions) -> DataFrame:
    """Links (``a``, ``b``: components) between different components within the buckets, stored.

    A bucket that still holds several components is compared on full sets, in pairs of bounded blocks. The nodes of
    larger buckets are grouped anew by their rare shingles.
    """
    rows = cut_lineage(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))

    def still_open(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("shingles").alias("total"))
        blocks = F.expr(f"cast(ceil(greatest(total / {options.block}.0, n / {options.block_sets}.0)) as int)")
        return ends.where("low <> high").select("key", blocks.alias("blocks"))

    keys = cut_lineage(still_open(rows))
    rows = rows.join(keys, "key")
    small = rows.where(F.col("blocks") <= options.most_blocks).withColumn("rare", F.lit(False))
    if keys.where(F.col("blocks") > options.most_blocks).isEmpty():
        rows = small
    else:
        large = cut_lineage(rows.where(F.col("blocks") > options.most_blocks).select("node", "component").distinct())
        sizes = sets.select("node", F.expr("octet_length(items) div 8").alias("shingles"))
        rare = cut_lineage(_by_rare_shingles(large, sets, options.percent).join(sizes, "node"))
        rare = rare.join(cut_lineage(still_open(rare)), "key")
        rows = small.unionByName(rare.withColumn("rare", F.lit(True)))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).join(sets, "node")
    groups = rows.groupBy("rare", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    lists = groups.agg(F.collect_list(F.struct("component", "block", "items")).alias("rows")).where(F.size("rows") > 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for across, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                component, block = (group.values.field(f).to_numpy() for f in range(2))
                items = [np.frombuffer(x, np.uint64) for x in group.values.field(2).to_pylist()]
                links += _forest(component, component, block, items, across, options.percent)
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    groups_of = lists.select((F.col("i") != F.col("j")).alias("across"), "rows")
    return stored_in_batches(groups_of.mapInArrow(work, "a long, b long"), 16)


def near_duplicates(docs: DataFrame, options: NearDupOptions = OPTIONS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``; then ``text_hash`` and the number
    of the ``component``.

    Reads ``doc_id`` and ``text``. Two documents are linked if their full shingle sets are similar enough;
    ``component_id`` is the smallest ``doc_id`` reachable over links. Null and empty texts have an empty set, link
    with nothing and are their own component. Rows of one id are separate documents; equal rows are copies of each other
    and all have the id that is kept. A null id is no candidate for the smallest; alone it stays, with null as its
    component. An empty table gives no rows. Sketches, buckets, links and components stay distributed.
    """
    rows = _sketched(docs, options)
    prints = ["fp1", "fp2"]
    worded = rows.where("n_shingles > 0")
    classes = cut_lineage(worded.groupBy(*prints).agg(F.min("uid").alias("node"), F.min("doc_id").alias("first_id")))
    first = worded.withColumnRenamed("uid", "node").join(classes.select("node"), "node", "left_semi")
    first = cut_lineage(first.select("node", "doc_id", "text_hash", "n_shingles", "keys"))
    keys = first.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("shingles"))
    buckets = cut_lineage(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").drop("last"))
    members = cut_lineage(keys.join(buckets, "key"))
    wanted = first.select("doc_id", "text_hash", "node").join(members.select("node").distinct(), "node", "left_semi")
    sets = _sets(docs, wanted, options)
    # One comparison for each node joins most groups; what a bucket still holds apart is then compared in full.
    pivots = members.where("node <> pivot").groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a"))
    links = _confirmed(pivots.select("a", "b"), sets, options.percent)
    labels = cut_lineage(components(links))
    more = _open_links(members.drop("pivot"), labels, sets, options)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not more.isEmpty():  # what the first links left apart: only the components meet, not their nodes again
        joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        named = named.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    named = cut_lineage(named)
    ids = cut_lineage(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    found = cut_lineage(named.join(ids, "component").select(*prints, "component_id", "component"))
    done = rows.select("doc_id", "n_shingles", "text_hash", "uid", *prints).join(found, prints, "left")
    own = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    done = done.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash", F.coalesce("component", "uid").alias("component"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return done.select("doc_id", "n_shingles", "component_id", kept, "text_hash", "component")


def drop_near_duplicates(docs: DataFrame, options: NearDupOptions = OPTIONS) -> DataFrame:
    """``docs`` with all their columns, one row of each component: of its smallest id, and of several such rows the one
    with the smallest hash of its text. Documents without words all stay, but equal rows among them once."""
    id_, hash_, own = fresh(docs, "_id", "_hash", "_own_hash")
    kept = near_duplicates(docs, options).where("kept").groupBy("component").agg(F.first("doc_id").alias(id_), F.min("text_hash").alias(hash_))
    kept = cut_lineage(kept.select(id_, hash_).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    rows = docs.withColumn(own, F.xxhash64(F.col("text").cast("string"))).join(kept, same, "left_semi")
    return rows.dropDuplicates(["doc_id", own]).select(*docs.columns)
