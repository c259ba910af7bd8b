"""Ratios, rounding and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is zero."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def round_half(value: Column | str, digits: int = 0) -> Column:
    """Round the scaled double half away from zero, as the published figures are.

    ``F.round(x, 2)`` rounds the decimal spelling of ``x`` (0.285 gives 0.29);
    scaling first gives 0.28, which is what the published files hold.
    """
    scale = float(10**digits)
    return F.round(_col(value) * F.lit(scale)) / F.lit(scale)


def pct(part: Column | str, whole: Column | str, digits: int | None = 2) -> Column:
    """Percentage of ``whole``; NULL when ``whole`` is zero."""
    value = F.try_divide(F.lit(100.0) * _col(part), _col(whole).cast("double"))
    return value if digits is None else round_half(value, digits)


def bin_edges(col: Column | str, bins: Sequence[tuple[int | None, int | None, str]]) -> Column:
    """Label of the first inclusive ``(low, high, label)`` range holding the value."""
    value = _col(col)
    label = F
    for low, high, name in bins:
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value <= high)
        label = label.when(test & value.isNotNull(), F.lit(name))
    return label.otherwise(F.lit(None).cast("string"))


def touches_bin(col: Column | str) -> Column:
    return bin_edges(col, [(1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, None, "4+")])


def latency_bin(col: Column | str) -> Column:
    return bin_edges(col, [(0, 0, "0"), (1, 2, "1-2"), (3, 7, "3-7"), (8, None, "8+")])
