"""Channel fact tables: bounded scans and the conformed union.

A scan is bounded on the partition column ``dt`` in that column's own type (one
source keeps it as text, the others as DATE), so partitions are pruned before
any file is opened. A union moves no rows: the channels exclude each other.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import folded
from touchpath.schemas import CHANNEL_COLUMNS


@dataclass(frozen=True)
class ChannelSource:
    """Where one channel lives and how its table differs from the others."""

    channel: str
    table: str | DataFrame
    partition_type: str = "date"  # or "string"
    has_step_name: bool = False
    #: Channels told apart by ``step_name`` inside a mixed table; others are not campaign sends.
    mixed_channels: tuple[str, ...] = ()
    #: Profile key this channel's account ids belong to.
    identity_key: str = "external_id"

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.table if isinstance(self.table, DataFrame) else spark.read.table(self.table)


def _in_column_type(day: dt.date, kind: str) -> Column:
    return F.lit(day.isoformat()) if kind == "string" else F.lit(day)


def campaign_filter(campaigns: Iterable[str], column: str = "campaign_id") -> Column:
    """Membership without regard to case or blanks; the list is folded once, here."""
    return folded(column).isin([c.strip().lower() for c in campaigns])


def scan_channel(
    spark: SparkSession,
    source: ChannelSource,
    since: dt.date,
    until: dt.date,
    instance: str | None = None,
    campaigns: Sequence[str] | None = None,
    logical_date: bool = False,
) -> DataFrame:
    """Rows of ``[since, until)`` by partition day.

    ``logical_date=True`` bounds ``date_send_dt`` instead, both ends included.
    That prunes no partition and is kept for exploration.
    """
    df = source.frame(spark)
    if logical_date:
        df = df.where(F.col("date_send_dt").between(F.lit(since), F.lit(until)))
    else:
        low = _in_column_type(since, source.partition_type)
        high = _in_column_type(until, source.partition_type)
        df = df.where((F.col("dt") >= low) & (F.col("dt") < high))
    if instance is not None:
        df = df.where(F.col("instance_tp") == instance)
    if source.mixed_channels:
        df = df.where(folded("step_name").isin([c.strip().lower() for c in source.mixed_channels]))
    if campaigns is not None:
        df = df.where(campaign_filter(campaigns))
    return df


def _conform(df: DataFrame, source: ChannelSource) -> DataFrame:
    df = df.withColumn("canal", F.lit(source.channel))
    if not source.has_step_name:
        df = df.withColumn("step_name", F.lit(None).cast("string"))
    return df.withColumns(
        {"date_send_dt": F.col("date_send_dt").cast("string"), "dt": F.col("dt").cast("string")}
    ).select(*CHANNEL_COLUMNS)


def union_channels(
    spark: SparkSession,
    sources: Sequence[ChannelSource],
    since: dt.date,
    until: dt.date,
    instance: str | None = None,
    campaigns: Sequence[str] | None = None,
) -> DataFrame:
    """All channels in the conformed layout (dates as text, ``step_name`` padded with NULL)."""
    frames = [
        _conform(scan_channel(spark, s, since, until, instance, campaigns), s) for s in sources
    ]
    return reduce(DataFrame.unionByName, frames)


def channel_touches(
    spark: SparkSession,
    source: ChannelSource,
    since: dt.date,
    until: dt.date,
    instance: str | None = None,
    campaigns: Sequence[str] | None = None,
) -> DataFrame:
    """Touches of one channel before identity: mixed tables name their channel per row."""
    df = scan_channel(spark, source, since, until, instance, campaigns)
    channel = F.lower(F.col("step_name")) if source.mixed_channels else F.lit(source.channel)
    return df.select(
        channel.alias(K.CHANNEL),
        "external_user_id",
        F.col("date_send_dt").alias(K.TOUCH_DATE),
        K.CAMPAIGN,
        K.STEP,
        K.VARIATION,
    )
