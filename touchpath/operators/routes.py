"""Routes: the ordered sequence of steps a subject received."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import pct, ratio, round_half, route_label
from touchpath.operators.ranking import size_ordinal
from touchpath.operators.windows import SUBJECT_KEY

ROUTE = (K.WAVE, "ruta_key")


def route_steps() -> Column:
    """Step names of ``ruta_key`` in order."""
    return F.split("ruta_key", K.ROUTE_SEPARATOR)


def _sends(touches: DataFrame, dedupe_steps: bool) -> DataFrame:
    """``pasos`` (a step per day it was sent on, in order), how often each (``veces``) and number of touches per subject.

    Touches are counted per subject, day and step before the subject shuffle: the list a task sorts is bounded by days
    x steps even for a subject that holds a large share of all rows.
    """
    counted = touches.groupBy(*SUBJECT_KEY, K.TOUCH_DATE, K.STEP).agg(F.count("*").alias("n"))
    times = F.lit(1).cast("long") if dedupe_steps else F.col("n")
    listed = counted.groupBy(*SUBJECT_KEY).agg(
        F.sort_array(F.collect_list(F.struct(K.TOUCH_DATE, K.STEP, times.alias("veces")))).alias("dias"),
        F.sum("n").alias("pasos_recibidos"),
    )
    return listed.select(*SUBJECT_KEY, F.col(f"dias.{K.STEP}").alias("pasos"), F.col("dias.veces").alias("veces"), "pasos_recibidos")


def _runs(sends: DataFrame) -> DataFrame:
    """``tramos`` (steps in order, with the number of sends in a row) in place of ``pasos`` and ``veces``.

    Sends of one step on several days in a row are one run, so equal routes have equal runs.
    """

    def opens(step: Column, at: Column) -> Column:
        return (at == 0) | (F.get("pasos", at - 1) != step)

    starts = F.filter(F.transform("pasos", lambda step, at: F.when(opens(step, at), at)), lambda at: at.isNotNull())
    ends = F.concat(F.slice("inicios", F.lit(2), F.size("inicios")), F.array(F.size("pasos")))

    def run(start: Column, end: Column) -> Column:
        total = F.aggregate(F.slice("veces", start + 1, end - start), F.lit(0).cast("long"), lambda x, y: x + y)
        return F.struct(F.get("pasos", start).alias("paso"), total.alias("veces"))

    return sends.withColumn("inicios", starts).withColumn("tramos", F.zip_with("inicios", ends, run)).drop("pasos", "veces", "inicios")


def _by_route(sends: DataFrame, **totals: Column) -> DataFrame:
    """``totals`` (counts and sums) per wave and ``tramos``: runs are made once for each distinct list of sends."""
    listed = sends.groupBy(K.WAVE, "pasos", "veces").agg(*[total.alias(name) for name, total in totals.items()])
    return _runs(listed).groupBy(K.WAVE, "tramos").agg(*[F.sum(name).alias(name) for name in totals])


def _spelled(runs: Column) -> Column:
    """Every send of ``runs`` by name. A route too long for one value is an error, never another form."""
    sends = F.transform(runs, lambda r: F.array_repeat(r["paso"], r["veces"].cast("int")))
    return F.array_join(F.flatten(sends), K.ROUTE_SEPARATOR)


def subject_routes(touches: DataFrame, dedupe_steps: bool = False) -> DataFrame:
    """``ruta_key`` and number of touches per subject, steps ordered by day, then name.

    ``dedupe_steps`` ignores repeated sends of a step on one day.
    """
    spelled = _spelled(F.col("tramos")).alias("ruta_key")
    return _runs(_sends(touches, dedupe_steps)).select(*SUBJECT_KEY, spelled, "pasos_recibidos")


def label_routes(sizes: DataFrame, size: str = "msisdn_en_ruta") -> DataFrame:
    """Routes named by size within the wave: the largest is A, ties by key."""
    ranked = size_ordinal(sizes, K.WAVE, size, "ruta_key", "ruta_num")
    return ranked.withColumn("ruta", route_label("ruta_num"))


def routes(touches: DataFrame, dedupe_steps: bool = False) -> DataFrame:
    """Distinct routes with size and label; a route is spelled once, after its subjects have been counted."""
    sizes = _by_route(_sends(touches, dedupe_steps), msisdn_en_ruta=F.count("*"))
    return label_routes(sizes.select(K.WAVE, _spelled(F.col("tramos")).alias("ruta_key"), "msisdn_en_ruta"))


def route_report(touches: DataFrame, attribution: DataFrame, dedupe_steps: bool = False) -> DataFrame:
    """Reach, conversion, latency and touches per route.

    Conversions are summed per subject first, so both sides of the join hold
    one row per subject and a single shuffle by route follows.
    """
    credit = attribution.groupBy(*SUBJECT_KEY).agg(
        F.count("*").alias("conv"),
        F.sum("dias_al_convertir").alias("dias"),
        F.sum("toques_previos").alias("toques"),
    )
    totals = _by_route(
        _sends(touches, dedupe_steps).join(credit, list(SUBJECT_KEY), "left"),
        msisdn_impactados=F.count("*"),
        msisdn_convertidos=F.count("conv"),
        conv=F.sum("conv"),
        dias=F.sum("dias"),
        toques=F.sum("toques"),
    )
    named = totals.withColumn("ruta_key", _spelled(F.col("tramos"))).drop("tramos")
    return label_routes(named, "msisdn_impactados").select(
        K.WAVE,
        "ruta_num",
        "ruta",
        "ruta_key",
        "msisdn_impactados",
        "msisdn_convertidos",
        pct("msisdn_convertidos", "msisdn_impactados").alias("tasa_pct"),
        round_half(ratio("dias", "conv"), 2).alias("dias_prom"),
        round_half(ratio("toques", "conv"), 2).alias("toques_prom"),
    )


def route_exclusives(report: DataFrame) -> DataFrame:
    """Per route: the steps no other route of the wave contains, in route order."""
    steps = route_steps()
    once = (
        report.select(*ROUTE, F.explode(F.array_distinct(steps)).alias("paso"))
        .groupBy(K.WAVE, "paso")
        .agg(F.count("*").alias("n"), F.min("ruta_key").alias("ruta_key"))
        .where("n = 1")
        .groupBy(*ROUTE)
        .agg(F.collect_set("paso").alias("propios"))
    )
    own = F.filter(steps, lambda s: F.array_contains("propios", s))
    named = F.nullif(F.array_join(own, K.EXCLUSIVE_SEPARATOR), F.lit(""))
    text = F.coalesce(named, F.lit(K.NO_EXCLUSIVE_STEPS))
    return report.join(once, list(ROUTE), "left").select(
        K.WAVE, "ruta", "ruta_key", "msisdn_impactados", text.alias("pasos_propios"),
        "msisdn_convertidos", "tasa_pct",
    )


def best_and_worst(report: DataFrame) -> DataFrame:
    """Per wave: highest and lowest converting route and the gap in percentage points.

    Equal rates are settled by size order: the larger route is the best, the
    smaller one the worst.
    """
    fields = F.struct(
        "tasa_pct", (-F.col("ruta_num")).alias("orden"), "ruta", "msisdn_impactados", "msisdn_convertidos"
    )
    ends = report.groupBy(K.WAVE).agg(
        F.max(fields).alias("mejor"), F.min(fields).alias("peor"), F.count("*").alias("rutas")
    )
    return ends.select(
        K.WAVE,
        "rutas",
        *[
            F.col(f"{end}.{name}").alias(f"{end}_{name}")
            for end in ("mejor", "peor")
            for name in ("ruta", "msisdn_convertidos", "msisdn_impactados", "tasa_pct")
        ],
        round_half(F.col("mejor.tasa_pct") - F.col("peor.tasa_pct"), 2).alias("brecha_pp"),
    )
