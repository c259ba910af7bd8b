"""Composition index: who converts through the journey, compared with everyone who converts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import pct, ratio, round_half
from touchpath.operators.ranking import top_per_group

VALUE_KEY = (K.WAVE, "dimension", "valor")


def _stacked(df: DataFrame, dimensions: Sequence[str], attributed: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("valor")) for d in dimensions])
    return df.select(
        K.WAVE,
        F.inline(cells),
        F.lit(attributed).alias("atribuida"),
        F.lit(1 - attributed).alias("base"),
    )


def composition(
    attribution: DataFrame, conversions: DataFrame, dimensions: Sequence[str] = K.CONVERSION_ATTRS
) -> DataFrame:
    """Attributed and base counts, shares and index of every value of every dimension.

    One job for all dimensions. Values found on one side only stay, with zero
    on the other: both facts are stacked and counted together, which is the
    full outer join of the two counts for the price of one shuffle.
    """
    stacked = _stacked(attribution, dimensions, 1).unionByName(_stacked(conversions, dimensions, 0))
    counts = stacked.groupBy(*VALUE_KEY).agg(
        F.sum("atribuida").alias("conv_atribuidas"), F.sum("base").alias("reno_base")
    )
    totals = counts.groupBy(K.WAVE, "dimension").agg(
        F.sum("conv_atribuidas").alias("total_atribuidas"), F.sum("reno_base").alias("total_base")
    )
    share = F.lit(100.0) * ratio("conv_atribuidas", "total_atribuidas")
    return counts.join(totals, [K.WAVE, "dimension"]).select(
        *VALUE_KEY,
        "conv_atribuidas",
        "reno_base",
        pct("conv_atribuidas", "total_atribuidas").alias("pct_atribuido"),
        pct("reno_base", "total_base").alias("pct_base"),
        round_half(F.try_divide(share, ratio("reno_base", "total_base")), 0).alias("indice"),
    )


def with_support(
    composed: DataFrame, minimum: int = K.MIN_SUPPORT, fallback: int = K.SUPPORT_FALLBACK
) -> DataFrame:
    """Values with enough attributed conversions, or the largest ones when none has enough."""
    group = [K.WAVE, "dimension"]
    enough = composed.where(F.col("conv_atribuidas") >= minimum)
    without = composed.join(enough.select(*group).distinct(), group, "left_anti").where("conv_atribuidas > 0")
    largest = top_per_group(without, group, [F.col("conv_atribuidas").desc(), F.col("valor")], fallback)
    return enough.unionByName(largest)


def top_values(composed: DataFrame, n: int) -> DataFrame:
    """The ``n`` values with most attributed conversions, per wave and dimension."""
    return top_per_group(
        composed.where("conv_atribuidas > 0"),
        [K.WAVE, "dimension"],
        [F.col("conv_atribuidas").desc(), F.col("valor")],
        n,
    )
