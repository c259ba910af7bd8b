"""Profile snapshots: read a few chosen days instead of the whole history."""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_today(spark: SparkSession) -> dt.date:
    """Today in the session's time zone, whatever the driver's clock is set to."""
    return spark.sql("SELECT current_date()").first()[0]


def rolling_range(days: int, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """The last ``days`` days up to ``as_of``, end exclusive."""
    return as_of - dt.timedelta(days=days), as_of


def snapshot_dates(days: int, as_of: dt.date) -> list[str]:
    """First, middle and latest snapshot of a rolling range, as the text the partition holds."""
    return [(as_of - dt.timedelta(days=n)).isoformat() for n in (days, days // 2, 1)]


def scan_profile(
    spark: SparkSession,
    table: str | DataFrame,
    snapshots: Sequence[str],
    country: str | None = None,
    keys: Sequence[str] = ("external_id",),
    subject: str = "msisdn",
    require_subject: bool = True,
) -> DataFrame:
    """Identity columns of the chosen snapshots; ``fct_dt`` literals prune partitions."""
    df = table if isinstance(table, DataFrame) else spark.read.table(table)
    df = df.where(F.col("fct_dt").isin(list(snapshots)))
    if country is not None:
        df = df.where(F.col("cntry_cd") == country)
    if require_subject:
        df = df.where(F.col(subject).isNotNull())
    return df.select("fct_dt", *keys, subject)


def snapshot_counts(profile: DataFrame) -> DataFrame:
    """Rows per snapshot, to see that every chosen day exists and is complete."""
    return profile.groupBy("fct_dt").agg(F.count("*").alias("filas"))


def snapshot_gaps(profile: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """Chosen snapshots that ``profile`` does not hold; a scan of them would silently read fewer."""
    chosen = profile.sparkSession.createDataFrame([(s,) for s in snapshots], "fct_dt string")
    existing = profile.where(F.col("fct_dt").isin(list(snapshots))).select("fct_dt").distinct()
    return chosen.join(existing, "fct_dt", "left_anti")


def existing_snapshots(profile: DataFrame) -> DataFrame:
    return profile.select("fct_dt").distinct()


def choose_snapshots(profile: DataFrame, wanted: Sequence[str]) -> dict[str, str]:
    """For each wanted day the snapshot to read: the latest one not after it; before the first snapshot, the first one.

    Only the days the table holds are looked at (a partition listing where ``fct_dt`` is a partition column). Days are text.
    """
    held = sorted(r["fct_dt"] for r in existing_snapshots(profile).where("fct_dt IS NOT NULL").collect())
    return {day: held[max(0, bisect.bisect_right(held, day) - 1)] for day in dict.fromkeys(wanted)} if held else {}


def nearest_snapshots(profile: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``choose_snapshots`` as rows, to say what was read: ``pedido``, ``fct_dt`` and their distance ``dias``."""
    chosen = choose_snapshots(profile, wanted)
    rows = profile.sparkSession.createDataFrame(list(chosen.items()), "pedido string, fct_dt string")
    return rows.withColumn("dias", F.date_diff(F.col("pedido").cast("date"), F.col("fct_dt").cast("date")))


def scan_nearest_profile(
    spark: SparkSession, table: str | DataFrame, wanted: Sequence[str], country: str | None = None, keys: Sequence[str] = ("external_id",)
) -> DataFrame:
    """Identity columns of the snapshots nearest to the ``wanted`` days, each once; ``fct_dt`` says which were read.

    The choice is made when the plan is built, so that literals prune partitions.
    """
    df = table if isinstance(table, DataFrame) else spark.read.table(table)
    return scan_profile(spark, df, sorted(set(choose_snapshots(df, wanted).values())), country, keys)
