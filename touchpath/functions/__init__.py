"""Column functions. All but the p-value stay inside Catalyst."""

from touchpath.functions.dates import (
    days_between,
    local_date,
    month_starts,
    plain_date,
    weekday_label,
    weekday_number,
)
from touchpath.functions.keys import subject_key, suffix_key
from touchpath.functions.labels import (
    channel_priority,
    folded,
    label_or,
    match_source,
    route_label,
    title_case,
    upper_label_or,
)
from touchpath.functions.numbers import bin_edges, latency_bin, pct, ratio, round_half, touches_bin
from touchpath.functions.stats import two_proportion_z, two_sided_p

__all__ = [
    "bin_edges",
    "channel_priority",
    "days_between",
    "folded",
    "label_or",
    "latency_bin",
    "local_date",
    "match_source",
    "month_starts",
    "pct",
    "plain_date",
    "ratio",
    "round_half",
    "route_label",
    "subject_key",
    "suffix_key",
    "title_case",
    "touches_bin",
    "two_proportion_z",
    "two_sided_p",
    "upper_label_or",
    "weekday_label",
    "weekday_number",
]
