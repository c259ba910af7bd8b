"""Last-touch attribution without a range join.

The windows of a subject follow each other without gaps, so the only touch
day that can own a conversion is the latest one not after it. Each side is
first reduced to one row per subject and day (map-side partial aggregation),
then both are put on one timeline per subject and a running ``last`` carries
the latest touch day forward. A subject holding a third of all rows still
brings at most two rows per calendar day to its task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import channel_priority, days_between
from touchpath.operators.skew import lookup_join
from touchpath.operators.windows import SUBJECT_KEY

DAY_KEY = (*SUBJECT_KEY, K.TOUCH_DATE)
CONVERSION_KEY = (*SUBJECT_KEY, K.CONV_DATE)

#: Output order of the attribution detail.
DETAIL_COLUMNS = (
    K.WAVE, K.SUBJECT, K.CONV_DATE, *K.CONVERSION_ATTRS, K.ACCOUNT, K.TOUCH_DATE, K.CHANNEL, K.STEP,
    K.VARIATION, "dias_al_convertir", "canales_mismo_dia", "toques_previos",
)


def touch_days(
    touches: DataFrame,
    priority: Mapping[str, int] = K.CHANNEL_PRIORITY,
    tie_policy: str = "priority",
) -> DataFrame:
    """One row per subject and touch day: number of touches and the winning one.

    Lowest priority number wins, then channel, step, variation and account in
    text order, so the winner does not depend on row order. With
    ``tie_policy="merge"`` the channel becomes all channels of the day joined
    by ``+`` instead of the winner's alone.
    """
    rank = channel_priority(K.CHANNEL, priority).alias("prioridad")
    aggs = [
        F.count("*").alias("toques_dia"),
        F.min(F.struct(rank, *K.TOUCH_ATTRS)).alias("ganador"),
    ]
    if tie_policy == "merge":
        aggs.append(F.array_join(F.sort_array(F.collect_set(K.CHANNEL)), "+").alias("canales"))
    elif tie_policy != "priority":
        raise ValueError(f"unknown tie policy {tie_policy!r}")
    days = touches.groupBy(*DAY_KEY).agg(*aggs)
    if tie_policy == "merge":
        days = days.withColumn("ganador", F.col("ganador").withField(K.CHANNEL, F.col("canales"))).drop(
            "canales"
        )
    return days


def conversion_days(conversions: DataFrame) -> DataFrame:
    """One row per subject and conversion day: number of records and the first in text order."""
    return conversions.groupBy(*CONVERSION_KEY).agg(
        F.count("*").alias("variantes"), F.min(F.struct(*K.CONVERSION_ATTRS)).alias("conversion")
    )


def conversion_owners(
    touches: DataFrame,
    conversions: DataFrame,
    last_touch_days: int = K.LAST_TOUCH_DAYS,
    priority: Mapping[str, int] = K.CHANNEL_PRIORITY,
    cap_all: bool = False,
    tie_policy: str = "priority",
) -> DataFrame:
    """Every conversion day with the touch day that owns it, if any.

    Besides the owner (``toque``, NULL when the day is unattributed) each row
    says whether the subject was ever touched, how many touches came before,
    and how many distinct records share the day, so the diagnostics need no
    further join. ``conversions`` must hold distinct records.
    """
    days = touch_days(touches, priority, tie_policy)
    return _owned(_touch_side(days, F.col("toques_dia")), _conversion_side(conversion_days(conversions)), last_touch_days, cap_all)


def _touch_side(days: DataFrame, counted: Column) -> DataFrame:
    """Touch days on the timeline; ``counted`` is what a day adds to the touches before a conversion."""
    return days.select(
        *SUBJECT_KEY,
        F.col(K.TOUCH_DATE).alias("dia"),
        F.lit(0).alias("lado"),
        "ganador",
        "toques_dia",
        counted.alias("toques_hasta"),
    )


def _conversion_side(days: DataFrame) -> DataFrame:
    return days.select(
        *SUBJECT_KEY, F.col(K.CONV_DATE).alias("dia"), F.lit(1).alias("lado"), "conversion", "variantes"
    )


def _owned(touched: DataFrame, converted: DataFrame, last_touch_days: int, cap_all: bool) -> DataFrame:
    """The parts of ``toque`` are carried forward one by one and put together last, so that a report which does not ask for
    the winner neither looks for it nor moves it: the columns are pruned down to the scan.
    """
    timeline = touched.unionByName(converted, allowMissingColumns=True)
    order = Window.partitionBy(*SUBJECT_KEY).orderBy("dia", "lado")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    touch_day = F.when(F.col("lado") == 0, F.col("dia"))
    seen = timeline.select(
        *SUBJECT_KEY, "dia", "lado", "conversion", "variantes",
        F.last(touch_day, ignorenulls=True).over(so_far).alias(K.TOUCH_DATE),
        F.last("ganador", ignorenulls=True).over(so_far).alias("ganador"),
        F.last("toques_dia", ignorenulls=True).over(so_far).alias("toques_dia"),
        F.sum("toques_hasta").over(so_far).alias("toques_previos"),
        F.max(touch_day).over(whole).alias("ultimo_toque"),
    ).where("lado = 1")
    in_cap = F.col("dia") < F.date_add(K.TOUCH_DATE, last_touch_days)
    # A later touch exists: the window is open until it, and the conversion precedes it.
    open_window = F.lit(False) if cap_all else F.col(K.TOUCH_DATE) < F.col("ultimo_toque")
    owned = F.coalesce(open_window | in_cap, F.lit(False))
    return seen.select(
        *SUBJECT_KEY,
        F.col("dia").alias(K.CONV_DATE),
        "conversion",
        "variantes",
        F.when(owned, F.struct(K.TOUCH_DATE, "ganador", "toques_dia")).alias("toque"),
        F.when(owned, F.col("toques_previos")).alias("toques_previos"),
        F.col("ultimo_toque").isNotNull().alias("impactado"),
    )


def last_touch_state(
    touches: DataFrame,
    priority: Mapping[str, int] = K.CHANNEL_PRIORITY,
    tie_policy: str = "priority",
    before: DataFrame | None = None,
) -> DataFrame:
    """What later batches need of the touches so far: per subject its last touch day and the touches up to it.

    ``before`` is the state of the earlier batches, whose days all lie before those of ``touches``.
    """
    days = touch_days(touches, priority, tie_policy).withColumn("toques_hasta", F.col("toques_dia"))
    if before is not None:
        days = days.unionByName(before)
    last = F.max_by(F.struct(K.TOUCH_DATE, "ganador", "toques_dia"), K.TOUCH_DATE).alias("ultimo")
    return days.groupBy(*SUBJECT_KEY).agg(last, F.sum("toques_hasta").alias("toques_hasta")).select(
        *SUBJECT_KEY, "ultimo.*", "toques_hasta"
    )


def extended_owners(
    owners: DataFrame,
    state: DataFrame,
    touches: DataFrame,
    conversions: DataFrame,
    last_touch_days: int = K.LAST_TOUCH_DAYS,
    priority: Mapping[str, int] = K.CHANNEL_PRIORITY,
    cap_all: bool = False,
    tie_policy: str = "priority",
) -> DataFrame:
    """``conversion_owners`` of all batches, from those of the earlier ones and a new batch of later days.

    New touches can change only conversions after their subject's last touch day so far: its window, which ended with
    the limit, stays open until the next touch. Those rows and the new ones are attributed again, with the ``state``
    (``last_touch_state``) as the one touch day of the past; all other rows are handed on. The log of the past is not
    read. Without such rows of the past, or without a state, a subject starts anew.
    """
    days = touch_days(touches, priority, tie_policy)
    again = days.select(*SUBJECT_KEY).distinct().withColumn("_otra_vez", F.lit(True))
    ends = state.select(*SUBJECT_KEY, F.col(K.TOUCH_DATE).alias("_ultimo"))
    old = owners.join(again, list(SUBJECT_KEY), "left").join(ends, list(SUBJECT_KEY), "left")
    changes = F.col("_otra_vez").isNotNull() & (F.col("_ultimo").isNull() | (F.col(K.CONV_DATE) >= F.col("_ultimo")))
    kept = old.where(~changes).drop("_otra_vez", "_ultimo")
    converted = conversion_days(conversions).unionByName(
        old.where(changes).select(*CONVERSION_KEY, "variantes", "conversion")
    )
    touched = _touch_side(days, F.col("toques_dia")).unionByName(_touch_side(state, F.col("toques_hasta")))
    return kept.unionByName(_owned(touched, _conversion_side(converted), last_touch_days, cap_all))


def attribution_detail(owners: DataFrame, tie_count: str = "touches") -> DataFrame:
    """One attributed conversion per subject and day, with the winning touch.

    ``canales_mismo_dia`` counts the touches that competed on the owning day;
    ``tie_count="records"`` multiplies by the conversion records of the day,
    as joining records to touches does.
    """
    ties = F.col("toque.toques_dia")
    if tie_count == "records":
        ties = ties * F.col("variantes")
    elif tie_count != "touches":
        raise ValueError(f"unknown tie count {tie_count!r}")
    touch = {name: F.col(f"toque.ganador.{name}") for name in K.TOUCH_ATTRS}
    return (
        owners.where(F.col("toque").isNotNull())
        .select(
            *CONVERSION_KEY,
            "conversion.*",
            F.col(f"toque.{K.TOUCH_DATE}").alias(K.TOUCH_DATE),
            *[value.alias(name) for name, value in touch.items()],
            ties.alias("canales_mismo_dia"),
            "toques_previos",
        )
        .withColumn("dias_al_convertir", days_between(K.TOUCH_DATE, K.CONV_DATE))
        .select(*DETAIL_COLUMNS)
    )


def attribution_per_record(owners: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row per conversion *record*: records sharing a day keep their own attributes.

    The owner side has one row per key; a key that many records share is split.
    """
    winners = attribution_detail(owners).drop(*K.CONVERSION_ATTRS)
    return lookup_join(conversions, winners, CONVERSION_KEY).select(*DETAIL_COLUMNS)


def owning_windows(owners: DataFrame, windows: DataFrame) -> DataFrame:
    """Conversion days with the window they fall into."""
    found = owners.where(F.col("toque").isNotNull()).select(
        *CONVERSION_KEY, F.col(f"toque.{K.TOUCH_DATE}").alias(K.TOUCH_DATE)
    )
    return found.join(windows, list(DAY_KEY))


def unattributed(conversions: DataFrame, attribution: DataFrame) -> DataFrame:
    """Conversion records no touch may claim: the baseline (``attribution`` has one row per day)."""
    return lookup_join(conversions, attribution.select(*CONVERSION_KEY), CONVERSION_KEY, "left_anti")


def reached_conversions(conversions: DataFrame, touches: DataFrame) -> DataFrame:
    """Conversion records of subjects that were touched at any time."""
    subjects = touches.select(*SUBJECT_KEY).distinct()
    return lookup_join(conversions, subjects, SUBJECT_KEY, "left_semi")


def out_of_window(conversions: DataFrame, touches: DataFrame, attribution: DataFrame) -> DataFrame:
    """Records of touched subjects that no window covers."""
    return unattributed(reached_conversions(conversions, touches), attribution)


def ownership_counts(owners: DataFrame) -> DataFrame:
    """Per wave: attributed days, ties, baseline and out-of-window records, in one pass."""
    unowned = F.col("toque").isNull()
    return owners.groupBy(K.WAVE).agg(
        F.count_if(~unowned).alias("atribuciones"),
        F.count_if(F.col("toque.toques_dia") > 1).alias("empates"),
        F.coalesce(F.sum(F.when(unowned, F.col("variantes"))), F.lit(0)).alias("sin_atribuir"),
        F.coalesce(
            F.sum(F.when(unowned & F.col("impactado"), F.col("variantes"))), F.lit(0)
        ).alias("fuera_de_ventana"),
    )
