"""Ordinals and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Leading characters of a name by which equal sizes are counted before names are compared.
LEADING = (24, 96)


def size_ordinal(df: DataFrame, group: str, size: str, name: str, ordinal: str) -> DataFrame:
    """``ordinal`` 1, 2, 3 ... inside ``group``: largest ``size`` first, equal sizes by ``name`` (distinct in the group).

    A rank is counted, not sorted for: larger sizes come before, then names of the same size whose leading characters are
    smaller, in two steps. Every step is a window over counts of its parent: at most as many sizes as the square root
    of twice their sum, then the beginnings that follow one beginning. Only names that agree in size and in their first
    ``LEADING[-1]`` characters are compared with each other. No sampling, no job while the plan is built.

    ``df`` is read twice, for the counts and for its rows, so it is kept on the executors' disks from its first use on.
    """
    kept = df.withColumns({f"_lead{i}": F.substring(name, 1, n) for i, n in enumerate(LEADING)}).persist(StorageLevel.DISK_ONLY)
    levels = [[group, size], *([group, size, *(f"_lead{k}" for k in range(i + 1))] for i in range(len(LEADING)))]
    counts, offsets = kept.groupBy(*levels[-1]).agg(F.count("*").alias("_n")), None
    for keys in reversed(levels):
        here = counts if keys == levels[-1] else counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        last = F.col(keys[-1]).desc() if keys[-1] == size else F.col(keys[-1])
        earlier = Window.partitionBy(*keys[:-1]).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
        before = here.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_more"))
        if offsets is None:
            offsets = before.withColumnRenamed("_more", "_before")
        else:
            offsets = offsets.join(before, keys).withColumn("_before", F.col("_before") + F.col("_more")).drop("_more")
    place = F.row_number().over(Window.partitionBy(*levels[-1]).orderBy(name))
    ranked = kept.withColumn("_place", place).join(offsets, levels[-1])
    return ranked.withColumn(ordinal, F.col("_before") + F.col("_place")).drop("_place", "_before", *(f"_lead{i}" for i in range(len(LEADING))))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group; the limit is applied before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rn", position).where(F.col("_rn") <= n).drop("_rn")
