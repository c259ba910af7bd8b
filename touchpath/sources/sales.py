"""Sales events (monthly partitions), the campaign dimension and previews."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import month_starts

#: Event, business unit and billing codes of a renewal.
RENEWAL = "RENOVACION"
MOBILE = "MOBILE"
BILLABLE = "FACTURABLE"


def scan_sales(
    spark: SparkSession,
    table: str | DataFrame,
    since: dt.date,
    until: dt.date,
    event: str = RENEWAL,
    unit: str = MOBILE,
    billing: str = BILLABLE,
    conditional_unit: bool = False,
) -> DataFrame:
    """Sales of ``[since, until)``: month partitions first, real event dates inside them.

    The month list is derived from the bounds, tail month included. The unit
    test reads one plain column; ``conditional_unit=True`` keeps the CASE form,
    which returns the same rows for one event type but cannot be pushed down.
    """
    df = table if isinstance(table, DataFrame) else spark.read.table(table)
    if conditional_unit:
        unit_column = F.when(F.col("evnt_typ") == RENEWAL, F.col("sb_bs_un")).otherwise(F.col("mv_bs_un"))
    else:
        unit_column = F.col("sb_bs_un")
    return df.where(
        F.col("fct_dt").isin(month_starts(since, until))
        & (F.col("evnt_dt") >= F.lit(since))
        & (F.col("evnt_dt") < F.lit(until))
        & (F.col("evnt_typ") == event)
        & (unit_column == unit)
        & (F.col("bllbl_cd") == billing)
    )


def sales_conversions(sales: DataFrame) -> DataFrame:
    """One row per line and day: restated months and repeated lines collapse."""
    return sales.select(
        F.col("msisdn_dd").alias(K.SUBJECT), F.col("evnt_dt").alias(K.CONV_DATE)
    ).distinct()


def lookup_campaigns(campaigns: DataFrame, ids: Sequence[str], instance: str | None = None) -> DataFrame:
    df = campaigns.where(F.col("campaign_id_key").isin(list(ids)))
    return df if instance is None else df.where(F.col("d_instance_tp") == instance)


def created_between(
    campaigns: DataFrame, since: dt.datetime, until: dt.datetime, instance: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Campaigns whose text ``created_at_ts`` lies in the closed range."""
    created = F.col("created_at_ts").try_cast("timestamp_ntz")
    low, high = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in (since, until))
    df = campaigns.where(created.between(low, high))
    if instance is not None:
        df = df.where(F.col("d_instance_tp") == instance)
    return df if limit is None else df.limit(limit)


def preview(df: DataFrame, columns: Sequence[str] = (), rows: int = 10) -> DataFrame:
    """Look at a table: a few rows of some or all columns."""
    return (df.select(*columns) if columns else df).limit(rows)
