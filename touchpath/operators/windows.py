"""Validity windows: how long a touch day may claim a conversion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchpath import constants as K

#: Subject first: its digits fill the sort prefix, while a few wave names would make every
#: comparison read the whole key.
SUBJECT_KEY = (K.SUBJECT, K.WAVE)


def validity_windows(
    touches: DataFrame, last_touch_days: int = K.LAST_TOUCH_DAYS, cap_all: bool = False
) -> DataFrame:
    """``[fecha_envio, fin_ventana)`` per subject and touch day.

    A day is valid until the subject's next touch day; only the last one ends
    after ``last_touch_days``. ``cap_all`` applies that limit to every day.
    Duplicate days are dropped before the subject shuffle, so one subject
    brings at most one row per calendar day to its task.
    """
    days = touches.select(*SUBJECT_KEY, K.TOUCH_DATE).distinct()
    nxt = F.lead(K.TOUCH_DATE).over(Window.partitionBy(*SUBJECT_KEY).orderBy(K.TOUCH_DATE))
    cap = F.date_add(K.TOUCH_DATE, last_touch_days)
    end = F.least(nxt, cap) if cap_all else F.coalesce(nxt, cap)
    return days.withColumn("fin_ventana", end)


def period_bounds(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    """Per wave: first and last day over both facts (end exclusive) and the first touch day."""
    sides = touches.groupBy(K.WAVE).agg(
        F.min(K.TOUCH_DATE).alias("low"), F.max(K.TOUCH_DATE).alias("high"),
        F.min(K.TOUCH_DATE).alias("dia_cero"),
    ).unionByName(
        conversions.groupBy(K.WAVE).agg(
            F.min(K.CONV_DATE).alias("low"), F.max(K.CONV_DATE).alias("high"),
            F.lit(None).cast("date").alias("dia_cero"),
        )
    )
    return sides.groupBy(K.WAVE).agg(
        F.min("low").alias("desde"),
        F.date_add(F.max("high"), 1).alias("hasta"),
        F.min("dia_cero").alias("dia_cero"),
    )


def padded_interval(
    since: dt.date, until: dt.date, before: int = 9, after: int = 7
) -> dict[str, tuple[dt.date, dt.date]]:
    """Extraction bounds around a reported interval.

    Touches start ``before`` days early so the first conversions find their
    touch; conversions run ``after`` days late so the last touches get credit.
    Reports then keep the middle.
    """
    early, late = since - dt.timedelta(days=before), until + dt.timedelta(days=after)
    return {"touches": (early, until), "conversions": (early, late), "report": (since, until)}
