"""Text labels: sentinels, priorities, match sources and route names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchpath.constants import (
    DEFAULT_PRIORITY,
    MATCH_BOTH,
    MATCH_NONE,
    MATCH_ONLY,
    ROUTE_PREFIX,
)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def folded(col: Column | str) -> Column:
    """Lower case without surrounding blanks, the form ids and channels are compared in."""
    return F.lower(F.trim(_col(col)))


def label_or(col: Column | str, label: str) -> Column:
    """Trimmed text, or ``label`` when NULL or blank (NULL would never join)."""
    return F.coalesce(F.nullif(F.trim(_col(col)), F.lit("")), F.lit(label))


def upper_label_or(col: Column | str, label: str) -> Column:
    return label_or(F.upper(_col(col)), label)


def title_case(col: Column | str) -> Column:
    return F.initcap(_col(col))


def channel_priority(
    col: Column | str, priority: Mapping[str, int], default: int = DEFAULT_PRIORITY
) -> Column:
    """Rank of a channel, lower wins; channels not listed get ``default``."""
    if not priority:
        return F.lit(default)
    channel = _col(col)
    rank = F
    for name, value in priority.items():
        rank = rank.when(channel == name, F.lit(value))
    return rank.otherwise(F.lit(default))


def match_source(first: Column | str, second: Column | str, names: tuple[str, str]) -> Column:
    """Which of two identity keys found a subject."""
    by_first, by_second = _col(first).isNotNull(), _col(second).isNotNull()
    return (
        F.when(by_first & by_second, MATCH_BOTH)
        .when(by_first, MATCH_ONLY + names[0].upper())
        .when(by_second, MATCH_ONLY + names[1].upper())
        .otherwise(MATCH_NONE)
    )


def route_label(ordinal: Column | str, prefix: str = ROUTE_PREFIX) -> Column:
    """A for 1 ... Z for 26, then AA, AB ... as spreadsheets count."""
    n = _col(ordinal).cast("long")
    letters = []
    for place in reversed(range(7)):  # 26 ** 7 routes is beyond any subject count
        smallest = sum(26**i for i in range(place + 1))  # first number with a letter here
        digit = F.floor((n - smallest) / F.lit(26**place)) % 26
        letters.append(F.when(n >= smallest, F.char(digit + 65)).otherwise(""))
    return F.concat(F.lit(prefix), *letters)
