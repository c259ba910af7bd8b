"""Running totals over a hash-random order, without any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys are uniform in [0, 2^KEY_BITS), so equal slices of that range hold about equally many rows.
KEY_BITS = 60
ROWS_PER_SLICE = 250
SLICES_PER_SECTION = 1000


def uniform_key(*columns: Column) -> Column:
    """A key of ``KEY_BITS`` random bits that depends on the values alone."""
    text = F.concat_ws("/", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def running_total(rows: DataFrame, counts: DataFrame, group: list[str], key: str, ties: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``group`` that come before in (key, ties).

    ``counts`` has one row (``group``, ``n``: rows) for each group; group columns hold no null. A group is dealt out by
    slices of the key range, in the order of the key, so the range sort needs no sampling and every slice is small
    whatever the size of its group. Totals of slices, then of sections of slices, are added up above the rows. ``rows``
    is read twice: pass a stored table.
    """
    width = (F.expr(f"{1 << KEY_BITS}L div greatest(1L, ceil(n / {ROWS_PER_SLICE}.0))") + F.lit(1)).alias("_width")
    keyed = rows.join(counts.select(*group, width), group)
    keyed = keyed.withColumn("_slice", F.expr(f"`{key}` div _width")).withColumn("_section", F.expr(f"_slice div {SLICES_PER_SECTION}")).drop("_width")
    # Dealt by slice here, or the slices of a group would stay where the join by group has put them: in one task.
    keyed = keyed.repartition(*group, "_section", "_slice")
    slices = keyed.groupBy(*group, "_section", "_slice").agg(F.sum(value).alias("_total"))
    sections = slices.groupBy(*group, "_section").agg(F.sum("_total").alias("_total"))

    def above(df: DataFrame, part: list[str], order: str) -> DataFrame:
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_above", F.coalesce(F.sum("_total").over(window), F.lit(0).cast("long"))).drop("_total")

    starts = above(slices, [*group, "_section"], "_slice").join(
        above(sections, group, "_section").withColumnRenamed("_above", "_base"), [*group, "_section"]
    )
    starts = starts.select(*group, "_section", "_slice", (F.col("_above") + F.col("_base")).alias("_start"))
    order = Window.partitionBy(*group, "_section", "_slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(order), F.lit(0).cast("long"))
    return keyed.join(starts, [*group, "_section", "_slice"]).withColumn(name, F.col("_start") + inside).drop("_start", "_section", "_slice")
