"""Extraction: channel tables and profile snapshots to resolved touches and the row-level export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.operators.identity import identity_dictionary, resolve, resolve_touches
from touchpath.schemas import EXPORT_COLUMNS
from touchpath.sources.channels import ChannelSource, channel_touches, union_channels
from touchpath.sources.files import write_parquet
from touchpath.sources.profiles import rolling_range, scan_profile, session_today, snapshot_dates


def wave_touches(
    spark: SparkSession,
    sources: Sequence[ChannelSource],
    profile: DataFrame,
    since: dt.date,
    until: dt.date,
    keys: Sequence[str],
    instance: str | None = None,
    campaigns: Sequence[str] | None = None,
) -> DataFrame:
    """Resolved, deduplicated touches of one wave over all its channels."""
    frames = [channel_touches(spark, s, since, until, instance, campaigns) for s in sources]
    touches = reduce(DataFrame.unionByName, frames)
    return resolve_touches(touches, identity_dictionary(profile, keys), keys)


def export_events(
    spark: SparkSession,
    sources: Sequence[ChannelSource],
    profile: str | DataFrame,
    days: int,
    keys: Sequence[str],
    as_of: dt.date | None = None,
    instance: str | None = None,
    campaigns: Sequence[str] | None = None,
    country: str | None = None,
) -> DataFrame:
    """Every event of the rolling range with its subject; unmatched events keep NULL.

    Three snapshots stand for the range, which ends today unless ``as_of`` is given. Range and snapshots are literals,
    so both scans prune partitions. The one join keeps every row, so it splits heavy accounts. ``snapshot_gaps`` tells
    which of the chosen snapshots do not exist.
    """
    as_of = as_of or session_today(spark)
    since, until = rolling_range(days, as_of)
    events = union_channels(spark, sources, since, until, instance, campaigns)
    snapshots = scan_profile(spark, profile, snapshot_dates(days, as_of), country, keys)
    resolved = resolve(events, identity_dictionary(snapshots, keys), keys)
    return resolved.withColumnRenamed("external_user_id", K.ACCOUNT).select(*EXPORT_COLUMNS)


def split_unmatched(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with and without a subject: keep everything first, decide afterwards."""
    missing = F.col(K.SUBJECT).isNull()
    return events.where(~missing), events.where(missing)


def write_export(events: DataFrame, path: str) -> None:
    """Partitioned by channel and day."""
    write_parquet(events, path, (K.CHANNEL, "dt"))
