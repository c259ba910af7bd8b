"""Day arithmetic and tolerant date parsing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchpath.constants import WEEKDAYS


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _full(day: Column, sep: str) -> Column:
    """A separator after the month: the text is more than a year or a year and month."""
    return F.locate(sep, day, 6) > 0


def local_date(col: Column | str) -> Column:
    """Date as written, whatever time or offset follows it.

    ``2026-06-07 23:30:00.000 -0600`` is 7 June: the first ten characters
    already are the local date, and reading the offset would move evening
    touches to the next day. Shortened dates (year, year-month) are rejected.
    The common spelling is tried first; rows that parse pay for nothing else.
    """
    text = _text(col)
    day = F.substring(text, 1, 10)
    moment = F.substring(text, 1, 19).try_cast("timestamp_ntz").cast("date")
    return F.when(_full(day, "-"), F.coalesce(day.try_cast("date"), moment)).when(
        _full(day, "/"), F.replace(day, F.lit("/"), F.lit("-")).try_cast("date")
    )


def plain_date(col: Column | str) -> Column:
    """The whole text read as a date; anything but a full date gives NULL."""
    text = _text(col)
    return F.when(_full(text, "-"), text.try_cast("date")).when(
        _full(text, "/"), F.replace(text, F.lit("/"), F.lit("-")).try_cast("date")
    )


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(end, start)


def weekday_number(col: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(col) + 1


def weekday_label(col: Column | str, names: Sequence[str] = WEEKDAYS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), weekday_number(col))


def month_starts(since: dt.date, until: dt.date) -> list[dt.date]:
    """First day of every month touched by ``[since, until)``."""
    last = until - dt.timedelta(days=1)
    count = (last.year - since.year) * 12 + last.month - since.month + 1
    first = since.year * 12 + since.month - 1
    return [dt.date((first + i) // 12, (first + i) % 12 + 1, 1) for i in range(count)]
