"""Small tables written in code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], list(columns))


def wave_dimension(spark: SparkSession, waves: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Waves with label and colour: the one dimension every fact shares."""
    return literal_table(spark, ("wave", "wave_label", "color"), waves)
