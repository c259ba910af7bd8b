"""Scans and sinks: channel, profile, sales and campaign tables, CSV files, literal tables."""

from touchpath.sources.channels import (
    ChannelSource,
    campaign_filter,
    channel_touches,
    scan_channel,
    union_channels,
)
from touchpath.sources.files import (
    read_inferred_csv,
    read_text_csv,
    replace_partitions,
    write_csv,
    write_dimension_csv,
    write_parquet,
)
from touchpath.sources.literal import literal_table, wave_dimension
from touchpath.sources.profiles import (
    choose_snapshots,
    existing_snapshots,
    nearest_snapshots,
    rolling_range,
    scan_nearest_profile,
    scan_profile,
    session_today,
    snapshot_counts,
    snapshot_dates,
    snapshot_gaps,
)
from touchpath.sources.sales import (
    created_between,
    lookup_campaigns,
    preview,
    sales_conversions,
    scan_sales,
)

__all__ = [
    "ChannelSource",
    "campaign_filter",
    "channel_touches",
    "choose_snapshots",
    "created_between",
    "existing_snapshots",
    "literal_table",
    "nearest_snapshots",
    "lookup_campaigns",
    "preview",
    "read_inferred_csv",
    "read_text_csv",
    "replace_partitions",
    "rolling_range",
    "sales_conversions",
    "scan_channel",
    "scan_nearest_profile",
    "scan_profile",
    "scan_sales",
    "session_today",
    "snapshot_counts",
    "snapshot_dates",
    "snapshot_gaps",
    "union_channels",
    "wave_dimension",
    "write_csv",
    "write_dimension_csv",
    "write_parquet",
]
