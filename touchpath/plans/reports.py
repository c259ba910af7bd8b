"""Reports: reach next to conversion, distributions, cumulative curves and KPIs.

Facts are aggregated to the grain of the report first; only those small
results are joined to each other or to the step order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import days_between, pct, ratio, round_half, weekday_label, weekday_number
from touchpath.operators.ranking import top_per_group

MEAN_DAYS = "dias_prom"


def _mean_days() -> Column:
    return round_half(F.avg("dias_al_convertir"), 2).alias(MEAN_DAYS)


def reach_and_conversion(
    touches: DataFrame,
    attribution: DataFrame,
    keys: Sequence[str],
    reach: Sequence[Column] = (),
    conversion: Sequence[Column] = (),
) -> DataFrame:
    """Distinct subjects reached and converted per ``keys``; groups without conversions stay."""
    reached = touches.groupBy(K.WAVE, *keys).agg(
        F.countDistinct(K.SUBJECT).alias("msisdn_impactados"), *reach
    )
    converted = attribution.groupBy(K.WAVE, *keys).agg(
        F.countDistinct(K.SUBJECT).alias("msisdn_convertidos"), *conversion
    )
    return (
        reached.join(converted, [K.WAVE, *keys], "left")
        .withColumn("msisdn_convertidos", F.coalesce("msisdn_convertidos", F.lit(0)))
        .withColumn("tasa_pct", pct("msisdn_convertidos", "msisdn_impactados"))
    )


def day_channel_report(touches: DataFrame, attribution: DataFrame) -> DataFrame:
    """Per touch day and channel, with the English weekday.

    The log is reduced to subject and account first: the two distincts expand those rows only.
    """
    reached = touches.select(K.WAVE, K.TOUCH_DATE, K.CHANNEL, K.SUBJECT, K.ACCOUNT).distinct()
    report = reach_and_conversion(
        reached,
        attribution,
        [K.TOUCH_DATE, K.CHANNEL],
        [F.countDistinct(K.ACCOUNT).alias("cuentas_impactadas")],
        [F.count("*").alias("renovaciones"), _mean_days()],
    )
    return report.select(
        K.WAVE,
        K.TOUCH_DATE,
        F.date_format(K.TOUCH_DATE, "EEEE").alias("dia_semana"),
        K.CHANNEL,
        "msisdn_impactados",
        "cuentas_impactadas",
        "msisdn_convertidos",
        F.coalesce("renovaciones", F.lit(0)).alias("renovaciones"),
        "tasa_pct",
        MEAN_DAYS,
    )


def _ordered(first_days: DataFrame, first: str = "primera_fecha") -> DataFrame:
    """Step order over rows that already are aggregates of a step (a few per step and wave)."""
    wave = Window.partitionBy(K.WAVE)
    return (
        first_days.withColumn(first, F.min(first).over(Window.partitionBy(K.WAVE, K.STEP)))
        .withColumn("dia_cero", F.min(first).over(wave))
        .withColumn("paso_idx", F.dense_rank().over(wave.orderBy(first, K.STEP)))
        .withColumn("dia_rel", days_between("dia_cero", first))
    )


def step_order(touches: DataFrame) -> DataFrame:
    """Steps in the order they first went out, with the day counted from the wave's first touch."""
    first = touches.groupBy(K.WAVE, K.STEP).agg(F.min(K.TOUCH_DATE).alias("primera_fecha"))
    return _ordered(first).select(K.WAVE, K.STEP, "primera_fecha", "dia_cero", "paso_idx", "dia_rel")


def step_report(touches: DataFrame, attribution: DataFrame) -> DataFrame:
    """Per step and channel, in journey order. Reach and order come from one pass over the touches."""
    first = F.min(K.TOUCH_DATE).alias("primera_fecha")
    report = reach_and_conversion(touches, attribution, [K.STEP, K.CHANNEL], [first], [_mean_days()])
    return _ordered(report).select(
        K.WAVE, "paso_idx", K.STEP, K.CHANNEL, "primera_fecha", "dia_rel", "msisdn_impactados",
        "msisdn_convertidos", "tasa_pct", MEAN_DAYS,
    )


def step_variation_report(
    touches: DataFrame, attribution: DataFrame, ordered_by: DataFrame | None = None
) -> DataFrame:
    """Per step, variation and channel.

    ``ordered_by`` are the touches that define the step order when the report
    covers only part of them.
    """
    first = F.min(K.TOUCH_DATE).alias("primera_fecha")
    report = reach_and_conversion(
        touches, attribution, [K.STEP, K.VARIATION, K.CHANNEL], [first], [_mean_days()]
    )
    if ordered_by is None:
        report = _ordered(report)
    else:
        order = step_order(ordered_by).select(K.WAVE, K.STEP, "primera_fecha", "paso_idx")
        report = report.drop("primera_fecha").join(order, [K.WAVE, K.STEP])
    return report.select(
        K.WAVE, K.STEP, K.VARIATION, K.CHANNEL, "paso_idx", "primera_fecha", "msisdn_impactados",
        "msisdn_convertidos", "tasa_pct", MEAN_DAYS,
    )


def step_calendar(step_variation: DataFrame) -> DataFrame:
    """Step rows with the Spanish weekday the step first went out on."""
    return step_variation.select(
        K.WAVE, "paso_idx", K.STEP, K.VARIATION, K.CHANNEL, "primera_fecha",
        weekday_label("primera_fecha").alias("dia_semana"),
        "msisdn_impactados", "msisdn_convertidos", "tasa_pct", MEAN_DAYS,
    )


def steps_over_channels(report: DataFrame) -> DataFrame:
    """Step rows summed over channels. A subject reached on two channels counts twice, hence ``_sum``."""
    return report.groupBy(K.WAVE, K.STEP).agg(
        F.min("paso_idx").alias("paso_idx"),
        F.min("primera_fecha").alias("primera_fecha"),
        F.sum("msisdn_impactados").alias("impactados_sum"),
        F.sum("msisdn_convertidos").alias("convertidos_sum"),
        F.min(K.CHANNEL).alias(K.CHANNEL),
    )


def top_step(report: DataFrame, n: int = 1) -> DataFrame:
    """The step with most conversions over all channels, per wave; earlier steps win ties."""
    summed = steps_over_channels(report).withColumn("tasa", pct("convertidos_sum", "impactados_sum"))
    return top_per_group(
        summed, [K.WAVE], [F.col("convertidos_sum").desc(), F.col("paso_idx")], n
    )


def share_of_wave(
    df: DataFrame, value: str, name: str, digits: int | None = 2, within: Sequence[str] = (K.WAVE,)
) -> DataFrame:
    """Percent of the wave total; ``df`` is an aggregate with one row per axis value."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(name, pct(value, total, digits))


def distribution(attribution: DataFrame, column: str, name: str, digits: int | None = 2) -> DataFrame:
    """Conversions per value of a column and their percent of the wave."""
    counts = attribution.groupBy(K.WAVE, F.col(column).alias(name)).agg(F.count("*").alias("conv"))
    return share_of_wave(counts, "conv", "pct", digits)


def latency_distribution(attribution: DataFrame) -> DataFrame:
    return distribution(attribution, "dias_al_convertir", "dias")


def touch_distribution(attribution: DataFrame) -> DataFrame:
    return distribution(attribution, "toques_previos", "toques")


def channel_share(attribution: DataFrame) -> DataFrame:
    return distribution(attribution, K.CHANNEL, K.CHANNEL, None)


def weekday_distribution(
    spark: SparkSession, attribution: DataFrame, waves: Sequence[str]
) -> DataFrame:
    """Conversions per weekday; all seven days of every wave, Monday first."""
    counts = attribution.groupBy(K.WAVE, weekday_number(K.CONV_DATE).alias("dia_num")).agg(
        F.count("*").alias("conv")
    )
    week = spark.range(1, 8).select(
        F.explode(F.array(*[F.lit(w) for w in waves])).alias(K.WAVE),
        F.col("id").cast("int").alias("dia_num"),
    )
    full = week.join(counts, [K.WAVE, "dia_num"], "left").select(
        K.WAVE,
        "dia_num",
        F.element_at(F.array(*[F.lit(d) for d in K.WEEKDAYS]), F.col("dia_num")).alias("dia"),
        F.coalesce("conv", F.lit(0)).alias("conv"),
    )
    shared = share_of_wave(full, "conv", "pct")
    return shared.withColumn("pct", F.coalesce("pct", F.lit(0.0)))


def channel_by_sales_channel(attribution: DataFrame) -> DataFrame:
    """Message channel against the channel the sale closed in."""
    return attribution.groupBy(K.WAVE, K.CHANNEL, "canal_venta").agg(F.count("*").alias("conv"))


def channel_matrix(attribution: DataFrame, sales_channels: Sequence[str]) -> DataFrame:
    """The same with one column per listed sales channel."""
    return (
        attribution.groupBy(K.WAVE, K.CHANNEL)
        .pivot("canal_venta", list(sales_channels))
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )


def cumulative_by_date(attribution: DataFrame) -> DataFrame:
    """Running conversions per conversion day (windowed over one row per day)."""
    days = attribution.groupBy(K.WAVE, K.CONV_DATE).agg(F.count("*").alias("conv"))
    so_far = Window.partitionBy(K.WAVE).orderBy(K.CONV_DATE)
    return days.select(K.WAVE, K.CONV_DATE, F.sum("conv").over(so_far).alias("acumulado"))


def cumulative_by_relative_day(touches: DataFrame, attribution: DataFrame) -> DataFrame:
    """Running conversions by day since the wave's first touch, and their percent."""
    zero = touches.groupBy(K.WAVE).agg(F.min(K.TOUCH_DATE).alias("dia_cero"))
    days = attribution.groupBy(K.WAVE, K.CONV_DATE).agg(F.count("*").alias("conv"))
    wave = Window.partitionBy(K.WAVE)
    return (
        days.join(zero, K.WAVE)
        .withColumn("dia_rel", days_between("dia_cero", K.CONV_DATE))
        .select(
            K.WAVE,
            "dia_rel",
            F.sum("conv").over(wave.orderBy("dia_rel")).alias("acum"),
            F.sum("conv").over(wave).alias("_total"),
        )
        .withColumn("pct", pct("acum", "_total", None))
        .drop("_total")
    )


def kpi_report(touches: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per wave: volumes, rate (subjects), share (conversions), latency, steps.

    Touches are first reduced to subject and step, so the two exact distincts
    expand those rows and not the log. ``owners`` holds attributed and other
    conversion days alike, so credit and base come from one pass over it.
    """
    reach = (
        touches.groupBy(K.WAVE, K.SUBJECT, K.STEP)
        .agg(F.count("*").alias("n"))
        .groupBy(K.WAVE)
        .agg(
            F.countDistinct(K.SUBJECT).alias("impactados"),
            F.sum("n").alias("envios"),
            F.countDistinct(K.STEP).alias("pasos"),
        )
    )
    touched = F.col(f"toque.{K.TOUCH_DATE}")
    credit = (
        owners.select(
            K.WAVE,
            "variantes",
            "toques_previos",
            F.when(touched.isNotNull(), F.col(K.SUBJECT)).alias("convertido"),
            days_between(touched, K.CONV_DATE).alias("dias"),
        )
        .groupBy(K.WAVE)
        .agg(
            F.count("dias").alias("conversiones"),
            F.countDistinct("convertido").alias("convertidos"),
            F.sum("variantes").alias("reno_periodo"),
            F.median("dias").alias("lat_med"),
            round_half(F.avg("dias"), 1).alias("dias_prom"),
            round_half(F.avg("toques_previos"), 1).alias("toques_prom"),
        )
    )
    zero = F.lit(0)
    return (
        reach.join(credit, K.WAVE, "left")
        .select(
            K.WAVE,
            "impactados",
            "envios",
            F.coalesce("conversiones", zero).alias("conversiones"),
            F.coalesce("convertidos", zero).alias("convertidos"),
            F.coalesce("reno_periodo", zero).alias("reno_periodo"),
            "lat_med",
            "dias_prom",
            "toques_prom",
            "pasos",
        )
        .withColumn("tasa", F.coalesce(pct("convertidos", "impactados"), F.lit(0.0)))
        .withColumn("share", F.coalesce(pct("conversiones", "reno_periodo"), F.lit(0.0)))
    )


def approximate_reach(touches: DataFrame, keys: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Distinct subjects within about two percent in constant memory, for sizing a question."""
    return touches.groupBy(K.WAVE, *keys).agg(
        F.approx_count_distinct(K.SUBJECT, rsd).alias("msisdn_aprox")
    )


def reach_sketches(touches: DataFrame, keys: Sequence[str] = (K.CHANNEL,), log2_size: int = 14) -> DataFrame:
    """One sketch of the subjects per day and ``keys``, to store next to the log: ``2 ** log2_size`` registers each."""
    return touches.groupBy(K.WAVE, K.TOUCH_DATE, *keys).agg(F.hll_sketch_agg(K.SUBJECT, log2_size).alias("boceto"))


def reach_of_interval(sketches: DataFrame, since: object, until: object, keys: Sequence[str] = (K.CHANNEL,)) -> DataFrame:
    """Distinct subjects of ``[since, until)`` per ``keys`` (any of those the sketches have), merged from daily sketches.

    Days overlap in their subjects, so daily counts do not add up; sketches do. The log is not read again.
    """
    days = sketches.where((F.col(K.TOUCH_DATE) >= F.lit(since)) & (F.col(K.TOUCH_DATE) < F.lit(until)))
    return days.groupBy(K.WAVE, *keys).agg(F.hll_sketch_estimate(F.hll_union_agg("boceto")).alias("msisdn_aprox"))


def early_share(attribution: DataFrame, days: int = K.EARLY_DAYS) -> DataFrame:
    """Percent of conversions within ``days`` of the touch."""
    return attribution.groupBy(K.WAVE).agg(
        (F.lit(100.0) * ratio(F.count_if(F.col("dias_al_convertir") <= days), F.count("*"))).alias("pct")
    )


def count_by(df: DataFrame, column: str, counted: str, distinct: bool = False) -> DataFrame:
    """Non-null (or distinct) values of ``counted`` per value of ``column``."""
    count = F.countDistinct(counted) if distinct else F.count(counted)
    return df.groupBy(column).agg(count.alias("numero"))


def label_lengths(df: DataFrame, column: str) -> DataFrame:
    """Distinct spellings of a label with their length: shows hidden blanks."""
    return df.select(column).distinct().withColumn("largo", F.length(column))
