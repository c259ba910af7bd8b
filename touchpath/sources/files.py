"""CSV in, CSV and parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from touchpath.schemas import text_schema


def read_text_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    sep: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header, every column text, column names checked against the header."""
    return spark.read.csv(
        path,
        schema=text_schema(columns),
        header=True,
        sep=sep,
        encoding=encoding,
        enforceSchema=False,
        quote='"',
        escape='"',
    )


def read_inferred_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Types guessed from the data: exploration only, it reads the file twice and eats zeros."""
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One folder of CSV parts with a header each; tasks write in parallel."""
    df.write.mode(mode).option("escape", '"').partitionBy(*partition_by).csv(path, header=True)


def write_dimension_csv(composition: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per wave and dimension."""
    write_csv(composition, path, ("wave", "dimension"), mode)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Rebalanced before writing: AQE splits heavy partitions and merges tiny ones."""
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write ``df`` so that exactly the partitions it holds are replaced: a re-run gives the same table.

    Partitions that ``df`` has no row of stay as they are.
    """
    rows = df.hint("rebalance", *partition_by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
