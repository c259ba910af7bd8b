"""Exact top-k by inner product: MaxScore over shards.

Vectors hold whole numbers. A dimension is a query term, a shard's column of values its postings. In a shard the term's
contribution lies between two bounds, the product with the column's least and largest value. With a threshold (the
query's k-th score so far in the shard) the terms split: those with the smallest spans are non-essential if even their
largest contributions cannot lift a vector over the threshold. The essential postings are traversed for all
vectors; the others are probed in order of span, only for vectors that can still compete. Shards are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchpath.session import cut_lineage


@dataclass(frozen=True)
class SearchOptions:
    k: int = 20
    shard_rows: int = 4096
    query_rows: int = 1024
    first_rows: int = 512  # scored in full, for a first threshold
    probe_terms: int = 8  # looked up between two prunings


OPTIONS = SearchOptions()


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id`` and ``vector``: floor(scale * x) of every component as long.

    Rows without id or vector, or with a null, NaN or infinite component, are left out.
    """
    component = F.col("embedding")
    bad = F.exists(component, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & component.isNotNull()).where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(component, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vector"))


def _dealt(vectors: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Every row in one of ``n_own`` blocks of about equal size, once for each of the other side's blocks."""
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_own)).cast("int").alias(own)
    return vectors.select(*vectors.columns, block, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a (rows, dims) matrix; short vectors are filled up with zeros."""
    ids = rows.column("vec_id").to_numpy()
    lists = rows.column("vector").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(lengths) and (lengths == lengths[0]).all():
        return ids, flat.reshape(len(ids), -1)
    matrix = np.zeros((len(ids), int(lengths.max(initial=0))), dtype=np.int64)
    matrix[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, matrix


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where every partial sum is a whole number below 2^53, else int64."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if largest < 2**53 else np.int64


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Shard:
    """Postings of a block of vectors: one row of values per dimension, with its bounds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, options: SearchOptions = OPTIONS):
        self.ids, self.options = ids, options
        self.postings = np.ascontiguousarray(matrix.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, query_id: int, query: np.ndarray, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best vectors with another id, of those that reach ``floor`` if there is one."""
        k, first = self.options.k, self.options.first_rows
        own = self.ids != query_id
        place = np.flatnonzero(own[:first])
        scores = (query @ self.postings[:, :first])[place]
        best = _best(self.ids[place], scores, k)
        place, scores = place[best], scores[best]
        threshold = scores[-1] if len(scores) == k else None
        if floor is not None:
            threshold = floor if threshold is None else max(threshold, floor)
        more, more_scores = self._competitive(query, threshold, first)
        keep = own[more]
        place, scores = np.concatenate([place, more[keep]]), np.concatenate([scores, more_scores[keep]])
        best = _best(self.ids[place], scores, k)
        best = best if floor is None else best[scores[best] >= floor]
        return self.ids[place[best]], scores[best]

    def _competitive(self, query: np.ndarray, threshold: float | None, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from ``first`` on and full scores of the vectors that reach the threshold."""
        terms = np.flatnonzero(query)
        bounds = np.stack([query[terms] * self.low[terms], query[terms] * self.high[terms]])
        upper, span = bounds.max(axis=0), np.abs(bounds[1] - bounds[0])
        order = np.argsort(-span, kind="stable")
        terms, upper = terms[order], upper[order]
        rest = np.append(np.cumsum(upper[::-1])[::-1], 0)  # rest[i]: most that the terms from i on can give
        place = np.arange(first, self.postings.shape[1])
        if threshold is None:
            return place, query @ self.postings[:, first:]
        # Essential: the fewest terms of widest span without which the least of them plus all others stays below.
        least = np.append(0, np.cumsum(bounds.min(axis=0)[order]))
        essential = int(np.argmax(least + rest < threshold)) if (least + rest < threshold).any() else len(terms)
        scores = query[terms[:essential]] @ self.postings[terms[:essential], first:]
        at = essential
        while True:
            alive = scores + rest[at] >= threshold
            place, scores = place[alive], scores[alive]
            if at >= len(terms) or not len(place):
                return place, scores
            probe = terms[at : at + self.options.probe_terms]
            scores = scores + query[probe] @ self.postings[probe[:, None], place[None, :]]
            at += len(probe)


def top_k(vectors: DataFrame, queries: DataFrame, options: SearchOptions = OPTIONS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` best vectors for every query.

    Both tables hold ``vec_id`` and ``vector`` (array of long, see ``whole_vectors``); a query's own id is no candidate,
    ties go to the smaller id, fewer than ``k`` candidates are all returned. A repeated candidate row counts as often as
    it stands; of several queries with one id the one with the smallest vector asks. Vectors of other lengths are filled
    up with zeros. Empty tables give no rows. Queries and vectors meet block by block, each pair of blocks as a bounded
    group of its own; both sides may grow. The first shard, a hash share of the vectors, is searched before the others, and
    its ``k``-th score is the floor that a vector of any other shard must reach: they prune by it and return little.
    """
    stored = cut_lineage(vectors.select("vec_id", "vector"))
    asked = cut_lineage(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).toDF("asked_id", "asked"))
    n_shards = -(-max(1, stored.count()) // options.shard_rows)
    n_blocks = -(-max(1, asked.count()) // options.query_rows)
    dealt = _dealt(stored, "shard", n_shards, "block", n_blocks)

    def searched(shards: Column, queries: DataFrame) -> DataFrame:
        left = dealt.where(shards).groupBy("shard", "block")
        own = queries.select(F.col("asked_id").alias("vec_id"), F.col("asked").alias("vector"), "floor")
        right = _dealt(own, "block", n_blocks, "shard", n_shards).where(shards).groupBy("shard", "block")
        return left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")

    names = ["query_id", "vec_id", "score"]

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        ids, matrix = _matrix(vectors)
        query_ids, wanted = _matrix(queries)
        dims = max(matrix.shape[1], wanted.shape[1])
        matrix, wanted = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (matrix, wanted))
        kind = _exact_type(matrix, wanted)
        shard = Shard(ids, matrix.astype(kind), options)
        floors = queries.column("floor").to_pylist()
        found = [shard.top(q, v, f) for q, v, f in zip(query_ids, wanted.astype(kind), floors, strict=True)]
        scores = np.concatenate([s for _, s in found]).astype(np.int64)
        return pa.table([np.repeat(query_ids, [len(f) for f, _ in found]), np.concatenate([f for f, _ in found]), scores], names)

    opened = cut_lineage(searched(F.col("shard") == 0, asked.withColumn("floor", F.lit(None).cast("long"))))
    floors = opened.groupBy(F.col("query_id").alias("asked_id")).agg(F.when(F.count("*") >= options.k, F.min("score")).alias("floor"))
    found = opened.union(searched(F.col("shard") > 0, asked.join(floors, "asked_id", "left")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
