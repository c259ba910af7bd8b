"""The plans themselves: what is shuffled, what is broadcast, and how much one task can get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import conversions, executed_plan, touches
from touchpath import Journey, JourneyConfig
from touchpath.operators import attribution as A
from touchpath.operators import composition as CO
from touchpath.operators import identity as I
from touchpath.operators import quality as Q
from touchpath.operators import routes as R
from touchpath.plans import reports as P
from workload import views as V


@pytest.fixture(scope="module")
def journey(spark, sf_dir):
    return V.events_journey(spark, sf_dir)


def initial(df):
    """Static plan, before run-time statistics."""
    return executed_plan(df)


def test_attribution_has_one_subject_shuffle(journey):
    plan = initial(journey.attribution)
    by_subject = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    days = [line for line in by_subject if "fecha" in line]
    assert len(by_subject) == 3 and len(days) == 2  # touch days, conversion days, then subjects
    assert "Join" not in plan.split("Union")[0]


def test_touches_are_reduced_before_they_are_shuffled(journey):
    plan = initial(journey.attribution)
    assert plan.count("partial_min") == 2


def test_no_cartesian_or_nested_loop_anywhere(spark, journey):
    j = journey
    frames = [
        j.windows, j.attribution, j.period, P.step_report(j.touches, j.attribution),
        P.day_channel_report(j.touches, j.attribution), P.kpi_report(j.touches, j.owners),
        P.cumulative_by_relative_day(j.touches, j.attribution), CO.composition(j.attribution, j.conversions),
        Q.quality_report(j.touches, j.conversions, j.owners),
        CO.with_support(CO.composition(j.attribution, j.conversions)),
    ]
    for df in frames:
        plan = initial(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_python_in_the_hot_path(journey):
    plan = initial(CO.composition(journey.attribution, journey.conversions))
    assert "Python" not in plan and "Pandas" not in plan


def test_scan_is_pushed_down_and_pruned(spark, sf_dir, journey):
    plan = initial(V.orders_journey(spark, sf_dir).windows)
    assert "l_suppkey" not in plan.split("ReadSchema")[1]
    assert "In(event_type" in initial(journey.attribution)


def test_key_and_date_are_parsed_once_a_row(spark, sf_dir, journey):
    for df in (journey.touches, journey.conversions, V.orders_journey(spark, sf_dir).touches):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") == 1


def test_a_hot_subject_brings_at_most_two_rows_per_day(spark):
    """A third of the log on one subject: what reaches its window task is bounded by the calendar."""
    log = spark.range(30000).select(
        F.lit("w").alias("wave"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5000)).alias("msisdn"),
        F.date_add(F.lit("2026-06-01").cast("date"), (F.col("id") % 20).cast("int")).alias("fecha_envio"),
        F.element_at(F.array(F.lit("sms"), F.lit("push")), (F.col("id") % 2 + 1).cast("int")).alias("canal"),
        F.lit("s").alias("canvas_step_nm"), F.lit("v").alias("canvas_variation_nm"),
        F.col("id").cast("string").alias("cuenta_id"),
    )
    days = A.touch_days(log)
    assert days.where("msisdn = 'hot'").count() == 20
    assert days.agg(F.sum("toques_dia")).first()[0] == 30000
    runs = R.subject_routes(log).where("msisdn = 'hot'").first()
    assert runs.pasos_recibidos == 10000
    sold = log.select("wave", "msisdn", F.col("fecha_envio").alias("fecha_conv"), F.col("cuenta_id").alias("canal_venta"),
                      *[F.lit("x").alias(c) for c in ("ciudad", "departamento", "plan_nm", "plan_detalle")])
    assert A.conversion_days(sold).where("msisdn = 'hot'").count() == 20
    owners = A.conversion_owners(log, sold)
    assert owners.agg(F.sum("variantes")).first()[0] == 30000


def test_resends_of_a_hot_account_collapse_before_the_join(spark):
    sends = spark.createDataFrame(
        [("1", "d", "sms", "s", "v", "c")] * 50,
        "external_user_id string, fecha_envio string, canal string, canvas_step_nm string, canvas_variation_nm string, campaign_id string",
    )
    profile = spark.createDataFrame([("1", "50200000001")], "first string, msisdn string")
    resolved = I.resolve_touches(sends, I.identity_dictionary(profile, ["first"]), ["first"])
    assert resolved.count() == 1
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert ":- Aggregate [" in plan.split("Join", 1)[1]  # the join reads distinct touches


def test_window_inputs_are_aggregates(spark):
    t, c = touches(spark, [("a", 1, "sms")]), conversions(spark, [("a", 1)])
    j = Journey(t, c, JourneyConfig(("w",)))
    for df in (P.step_order(t), P.cumulative_by_date(j.attribution), P.latency_distribution(j.attribution)):
        below = initial(df).split("Window")[-1]
        assert "HashAggregate" in below
