"""Semantic layer: named measures over the three facts, shared axes, slicers, calendar.

The facts have different grains and no relationship to each other. A measure
is aggregated on its own fact along the requested axes; the results meet on
those axes. Slicers are applied to every fact that has the column before
anything is aggregated; a slicer on an attribute of a dimension reaches every
fact that has the dimension's key. Measures may be made of other measures, some
of them in a wider context, and are evaluated in the order of what they need.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import days_between, ratio, weekday_label, weekday_number
from touchpath.operators.skew import lookup_join
from touchpath.plans.reports import step_order


@dataclass(frozen=True)
class Measure:
    """An aggregate of one fact; with ``over`` the ratio of two measures, ``scale`` times; with ``total`` another measure
    of the whole wave, whatever the other axes say, under the same slicers."""

    fact: str = ""
    expr: Callable[[], Column] | None = None
    over: tuple[str, str] | None = None
    scale: float = 1.0
    total: str = ""
    count: bool = True
    distinct: str = ""  # the column a distinct count is of


MEASURES: dict[str, Measure] = {
    "envios_totales": Measure("touches", lambda: F.sum("_sends")),
    "impactados": Measure("touches", lambda: F.countDistinct(K.SUBJECT), distinct=K.SUBJECT),
    "pasos_journey": Measure("touches", lambda: F.countDistinct(K.STEP), distinct=K.STEP),
    "renovaciones_atribuidas": Measure("attribution", lambda: F.count("*")),
    "convertidos": Measure("attribution", lambda: F.countDistinct(K.SUBJECT)),
    "latencia_mediana": Measure("attribution", lambda: F.median("dias_al_convertir"), count=False),
    "renovaciones_periodo": Measure("conversions", lambda: F.count("*")),
    "tasa_conversion": Measure(over=("convertidos", "impactados")),
    "share_atribucion": Measure(over=("renovaciones_atribuidas", "renovaciones_periodo")),
}

#: Who converts through the journey, compared with everyone who converts, along an axis both facts have.
COMPOSITION_MEASURES: dict[str, Measure] = {
    "renovaciones_base": Measure("conversions", lambda: F.count("*")),
    "pct_atribuido": Measure(over=("renovaciones_atribuidas", "total_atribuidas")),
    "pct_base": Measure(over=("renovaciones_base", "total_periodo")),
    "indice_composicion": Measure(over=("pct_atribuido", "pct_base"), scale=100.0),
    "total_atribuidas": Measure(total="renovaciones_atribuidas"),
    "total_periodo": Measure(total="renovaciones_periodo"),
}
MEASURES |= COMPOSITION_MEASURES

#: Date column each fact is filtered on by the calendar.
FACT_DATE = {"touches": K.TOUCH_DATE, "conversions": K.CONV_DATE, "attribution": K.CONV_DATE}


@dataclass(frozen=True)
class Dimension:
    """Attributes under a key that facts have too; the key ``date`` meets each fact's own date."""

    rows: DataFrame
    keys: tuple[str, ...]

    def keys_of(self, df: DataFrame, fact: str) -> dict[str, str] | None:
        """The fact's column for each key; None where the fact has no such key."""
        found = {key: FACT_DATE[fact] if key == "date" else key for key in self.keys}
        return found if set(found.values()) <= set(df.columns) else None


@dataclass(frozen=True)
class Slicers:
    """Selected values per column, value ranges, a calendar range (both ends included), and conditions on attributes of
    dimensions."""

    values: Mapping[str, Sequence[object]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[object, object]] = field(default_factory=dict)
    dates: tuple[object, object] | None = None
    weekdays: Sequence[int] = ()
    attributes: Sequence[tuple[Dimension, Column]] = ()

    def require(self, facts: Mapping[str, DataFrame]) -> None:
        """A slicer whose column no fact has would filter nothing: that is an error, not an empty choice."""
        known = {c for df in facts.values() for c in df.columns}
        unknown = sorted({*self.values, *self.ranges} - known)
        if unknown:
            raise ValueError(f"no fact has the slicer columns {unknown}")
        for dimension, _ in self.attributes:
            if not any(dimension.keys_of(df, fact) for fact, df in facts.items()):
                raise ValueError(f"no fact has the dimension's key {list(dimension.keys)}")

    def apply(self, df: DataFrame, fact: str) -> DataFrame:
        for column, wanted in self.values.items():
            if column in df.columns:
                df = df.where(F.col(column).isin(list(wanted)))
        for column, (low, high) in self.ranges.items():
            if column in df.columns:
                df = df.where(F.col(column).between(F.lit(low), F.lit(high)))
        day = FACT_DATE[fact]
        if self.dates is not None:
            df = df.where(F.col(day).between(F.lit(self.dates[0]), F.lit(self.dates[1])))
        if self.weekdays:
            df = df.where(weekday_number(day).isin(list(self.weekdays)))
        for dimension, condition in self.attributes:
            keys = dimension.keys_of(df, fact)
            if keys is not None:
                # A semi-join: the members prune the partitions of a stored fact and, where few, are broadcast by AQE.
                members = dimension.rows.where(condition).select(*(F.col(k).alias(f"_{own}") for k, own in keys.items()))
                df = df.join(members, [F.col(own) == F.col(f"_{own}") for own in keys.values()], "left_semi")
        return df


def evaluate(
    facts: Mapping[str, DataFrame],
    measures: Sequence[str],
    axes: Sequence[str] = (K.WAVE,),
    slicers: Slicers = Slicers(),
    rows_from: str | None = None,
) -> DataFrame:
    """Measures per combination of axis values.

    ``rows_from`` names the fact whose axis values make the rows; the others
    are looked up by those values. Without it every value of any fact is kept.
    Counts that find no row are zero, other measures NULL.
    """
    slicers.require(facts)
    order = _needed(measures)
    leaves = [n for n in order if MEASURES[n].expr is not None]
    totals = [n for n in order if MEASURES[n].total]
    if totals and K.WAVE not in axes:
        raise ValueError(f"{totals} are of a whole wave: the axes need it")
    result = _aggregated(facts, leaves, axes, slicers, rows_from)
    if totals:
        wider = _aggregated(facts, list(dict.fromkeys(MEASURES[n].total for n in totals)), (K.WAVE,), slicers, None)
        result = result.join(wider.select(K.WAVE, *(F.col(MEASURES[n].total).alias(n) for n in totals)), K.WAVE, "left")
    for name in order:
        measure = MEASURES[name]
        if measure.over is not None:
            result = result.withColumn(name, F.lit(measure.scale) * ratio(*measure.over))
    return result.select(*axes, *measures)


def _needed(measures: Sequence[str]) -> list[str]:
    """``measures`` and what they are made of, each after what it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for part in MEASURES[name].over or ():
                visit(part)
            order.append(name)

    for name in measures:
        visit(name)
    return order


def _aggregated(
    facts: Mapping[str, DataFrame], names: Sequence[str], axes: Sequence[str], slicers: Slicers, rows_from: str | None
) -> DataFrame:
    """Measures of the facts themselves, each on its own fact, met on the axes."""
    by_fact: dict[str, list[str]] = {}
    for name in names:
        by_fact.setdefault(MEASURES[name].fact, []).append(name)
    if rows_from is not None:
        by_fact = {rows_from: by_fact.pop(rows_from, []), **by_fact}
    result: DataFrame | None = None
    for fact, own in by_fact.items():
        aggs = [MEASURES[n].expr().alias(n) for n in own]
        rows = slicers.apply(facts[fact], fact)
        if fact == "touches":  # several distincts expand these rows, not the log
            kept = dict.fromkeys([*axes, *(MEASURES[n].distinct for n in own if MEASURES[n].distinct)])
            rows = rows.groupBy(*kept).agg(F.count("*").alias("_sends"))
        grouped = rows.groupBy(*axes)
        part = grouped.agg(*aggs) if aggs else grouped.agg(F.count("*").alias("_n")).drop("_n")
        how = "left" if rows_from is not None else "full_outer"
        result = part if result is None else result.join(part, list(axes), how)
    return result.withColumns({n: F.coalesce(n, F.lit(0)) for n in names if MEASURES[n].count})


def measure_by_wave(evaluated: DataFrame, measure: str, waves: Sequence[str], axes: Sequence[str] = ()) -> DataFrame:
    """One column per wave for a measure, and the gap of the first two in percentage points."""
    wide = evaluated.groupBy(*axes).agg(
        *[F.max(F.when(F.col(K.WAVE) == w, F.col(measure))).alias(f"{measure}_{w}") for w in waves]
    )
    if len(waves) < 2:
        return wide
    gap = (F.col(f"{measure}_{waves[0]}") - F.col(f"{measure}_{waves[1]}")) * 100
    return wide.withColumn("brecha_pp", gap)


def percent_of_wave(evaluated: DataFrame, measure: str, name: str = "pct_wave") -> DataFrame:
    """Share of the wave's total over the axis shown."""
    return evaluated.withColumn(name, ratio(measure, F.sum(measure).over(Window.partitionBy(K.WAVE))))


def cumulative(evaluated: DataFrame, measure: str, axis: str) -> DataFrame:
    """Running total along ``axis`` within the wave, and its share."""
    wave = Window.partitionBy(K.WAVE)
    running = F.sum(measure).over(wave.orderBy(axis))
    return evaluated.withColumns(
        {
            f"{measure}_acum": running,
            "pct_acum": ratio(running, F.sum(measure).over(wave)),
        }
    )


def filter_by_axis(df: DataFrame, selected: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Rows of one fact whose axis values occur in another, unrelated fact."""
    return lookup_join(df, selected.select(*axes).distinct(), axes, "left_semi")


def calendar(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row per day from the first to the last date of both facts."""
    bounds = [
        df.agg(F.min(day).alias("low"), F.max(day).alias("high"))
        for df, day in ((touches, K.TOUCH_DATE), (conversions, K.CONV_DATE))
    ]
    span = bounds[0].unionByName(bounds[1]).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    days = span.where("low is not null").select(
        F.explode(F.sequence("low", "high", F.expr("interval 1 day"))).alias("date")
    )
    return days.select(
        "date",
        F.year("date").alias("anio"),
        F.month("date").alias("mes_num"),
        F.date_format("date", "MMMM").alias("mes_nombre"),
        weekday_number("date").alias("dia_semana_num"),
        weekday_label("date", K.WEEKDAYS_ACCENTED).alias("dia_semana_nombre"),
    )


def step_dimension(touches: DataFrame) -> DataFrame:
    """Steps per wave with first day, day zero, order, relative day and a composite text key."""
    return step_order(touches).withColumn("clave_paso", F.concat_ws("|", K.WAVE, K.STEP))


def steps(touches: DataFrame) -> Dimension:
    """The steps, to slice by their order or relative day."""
    return Dimension(step_dimension(touches), (K.WAVE, K.STEP))


def days(touches: DataFrame, conversions: DataFrame) -> Dimension:
    """The calendar, to slice by year, month or weekday."""
    return Dimension(calendar(touches, conversions), ("date",))


def with_step(attribution: DataFrame, touches: DataFrame) -> DataFrame:
    """Attribution rows with ``paso_idx``, ``dia_rel`` and ``dia_cero`` of the step that gets the credit, and the day of the
    conversion counted from the wave's first touch."""
    order = step_order(touches).select(K.WAVE, K.STEP, "paso_idx", "dia_rel", "dia_cero")
    return attribution.join(order, [K.WAVE, K.STEP], "left").withColumn("dia_rel_conv", days_between("dia_cero", K.CONV_DATE))


def with_relative_day(attribution: DataFrame, touches: DataFrame, waves: Sequence[str]) -> DataFrame:
    """Attribution rows with the conversion day counted from the wave's first touch.

    Day zero is one row per configured wave; that list bounds the broadcast.
    """
    zero = (
        touches.where(F.col(K.WAVE).isin(list(waves)))
        .groupBy(K.WAVE)
        .agg(F.min(K.TOUCH_DATE).alias("dia_cero"))
    )
    return attribution.join(F.broadcast(zero), K.WAVE, "left").withColumn(
        "dia_rel_conv", days_between("dia_cero", K.CONV_DATE)
    )


def labelled(evaluated: DataFrame, waves: DataFrame) -> DataFrame:
    """Aggregates with the label and colour of their wave."""
    return evaluated.join(waves, K.WAVE, "left")
