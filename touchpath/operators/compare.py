"""Waves side by side: common categories, gaps and the two-proportion test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import round_half, two_proportion_z, two_sided_p
from touchpath.operators.ranking import top_per_group


def for_each_wave(values: DataFrame, waves: Sequence[str]) -> DataFrame:
    """Every row once per configured wave (a short list, written into the plan)."""
    return values.withColumn(K.WAVE, F.explode(F.array(*[F.lit(w) for w in waves])))


def dense_by_wave(
    df: DataFrame, waves: Sequence[str], keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Every key value found in any wave, present in all waves, missing measures zero."""
    grid = for_each_wave(df.select(*keys).distinct(), waves)
    return grid.join(df, [K.WAVE, *keys], "left").select(K.WAVE, *keys, *values).fillna(0, list(values))


def top_across_waves(
    composed: DataFrame, waves: Sequence[str], k: int = K.TOP_CATEGORIES
) -> DataFrame:
    """Categories largest over all waves together, each wave shown on that same list."""
    total = composed.groupBy("dimension", "valor").agg(F.sum("conv_atribuidas").alias("total"))
    leaders = top_per_group(total, ["dimension"], [F.col("total").desc(), F.col("valor")], k)
    values = ["conv_atribuidas", "reno_base", "pct_atribuido", "pct_base", "indice"]
    return (
        for_each_wave(leaders, waves)
        .join(composed, [K.WAVE, "dimension", "valor"], "left")
        .select(K.WAVE, "dimension", "valor", "total", *values)
        .fillna(0, values)
    )


def wave_columns(df: DataFrame, waves: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row: each measure of each wave in its own column (``<measure>_<wave>``)."""
    return df.agg(
        *[F.max(F.when(F.col(K.WAVE) == w, F.col(v))).alias(f"{v}_{w}") for w in waves for v in values]
    )


def compare_rates(kpi: DataFrame, first: str, second: str) -> DataFrame:
    """Conversion rates of two waves, their gap, and whether chance explains it."""
    side = wave_columns(kpi, (first, second), ("convertidos", "impactados", "tasa", "share"))
    z = two_proportion_z(
        f"convertidos_{first}", f"impactados_{first}", f"convertidos_{second}", f"impactados_{second}"
    )
    return (
        side.withColumn("brecha_pp", round_half(F.col(f"tasa_{first}") - F.col(f"tasa_{second}"), 2))
        .withColumn("z", z)
        .withColumn("p", two_sided_p("z"))
    )


def compare_ends(ends: DataFrame) -> DataFrame:
    """Two-proportion test of the best against the worst route of each wave."""
    z = two_proportion_z(
        "mejor_msisdn_convertidos", "mejor_msisdn_impactados",
        "peor_msisdn_convertidos", "peor_msisdn_impactados",
    )
    tested = ends.withColumn("z", F.when(F.col("rutas") > 1, z))
    return tested.withColumn("p", two_sided_p("z"))
