"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.session import cut_lineage

#: Up to ``FEW`` edges, a round runs in a task for every ``TASK_EDGES`` of them, whatever number of partitions a shuffle has;
#: hundreds of nearly empty tasks and files a step would cost more than the edges. More edges stay as Spark deals them.
FEW = 1_000_000
TASK_EDGES = 100_000


def _dealt(rows: DataFrame, edges: int) -> DataFrame:
    return rows.coalesce(max(1, -(-edges // TASK_EDGES))) if edges <= FEW else rows


def _stars(pairs: DataFrame, edges: int) -> DataFrame:
    """Joins every neighbour ``v`` of ``u`` to the smallest of ``u`` and its neighbours.

    The minima are stored before the join, so both sides of it come from a shuffle and a hub can be split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return _dealt(pairs.join(cut_lineage(_dealt(least, edges)), "u"), edges)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of ``links`` (``a``, ``b``: long): the smallest node it is connected with.

    Rounds grow with the logarithm of the longest path. Loops and repeated links change nothing; links with a null end
    are left out; no links give no rows. Edges are stored after each round.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges, n = _dealt(edges, state[0]), state[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, n).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _stars(cut_lineage(_dealt(large, n)), n)
        ends = F.explode(F.array("u", "v")).alias("u")
        edges = cut_lineage(_dealt(small.select(ends, F.col("least").alias("v")).where("u <> v").distinct(), n))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
