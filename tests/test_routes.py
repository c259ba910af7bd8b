from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from conftest import conversions, records, touches
from touchpath import constants as K
from touchpath.operators import attribution as A
from touchpath.operators import compare as C
from touchpath.operators import routes as R
from touchpath.operators.ranking import size_ordinal, top_per_group
from workload import views as V

TOUCHES = [
    ("a", 1, "sms", "one"), ("a", 3, "sms", "two"), ("b", 1, "sms", "one"), ("b", 3, "sms", "two"),
    ("c", 1, "sms", "one"), ("c", 2, "push", "three"), ("d", 2, "sms", "two"), ("d", 2, "sms", "one"),
    ("d", 2, "push", "one"),
]


def test_route_spells_every_send_in_order(spark):
    got = dict(records(R.subject_routes(touches(spark, TOUCHES)), K.SUBJECT, "ruta_key"))
    assert got == {"a": "one > two", "b": "one > two", "c": "one > three", "d": "one > one > two"}
    once = dict(records(R.subject_routes(touches(spark, TOUCHES), dedupe_steps=True), K.SUBJECT, "ruta_key"))
    assert once["d"] == "one > two"


def test_equal_spelling_is_one_route(spark):
    """Sends of a step in a row are one run, however they fall on days; very many sends change nothing."""
    rows = [("h", 1, "sms", "s")] * 50_000 + [("h", 2, "sms", "s")] * 2 + [("g", 1, "sms", "s")] * 2 + [("g", 2, "sms", "s")] * 50_000
    many = touches(spark, rows)
    found = R.routes(many).select("ruta_key", "msisdn_en_ruta").collect()
    assert [(r.ruta_key, r.msisdn_en_ruta) for r in found] == [(" > ".join(["s"] * 50_002), 2)]
    one = touches(spark, [("h", 1, "sms", "one")] * 50 + [("h", 2, "sms", "two"), ("h", 3, "sms", "one")])
    route = R.subject_routes(one).first()
    assert (route.ruta_key, route.pasos_recibidos) == (" > ".join(["one"] * 50 + ["two", "one"]), 52)
    short = touches(spark, [("h", 1, "sms", "one"), ("h", 2, "sms", "two")])
    report = R.route_report(short, A.attribution_detail(A.conversion_owners(short, conversions(spark, [("h", 3)]))))
    assert records(R.route_exclusives(report), "pasos_propios") == [("one y two",)]


def test_route_report_and_ends(spark):
    t, c = touches(spark, TOUCHES), conversions(spark, [("a", 4), ("b", 3), ("c", 2)])
    attribution = A.attribution_detail(A.conversion_owners(t, c))
    report = R.route_report(t, attribution)
    assert records(report, "ruta", "ruta_key", "msisdn_impactados", "msisdn_convertidos", "tasa_pct", "dias_prom") == [
        ("Ruta A", "one > two", 2, 2, 100.0, 0.5),
        ("Ruta B", "one > one > two", 1, 0, 0.0, None),
        ("Ruta C", "one > three", 1, 1, 100.0, 0.0),
    ]
    exclusives = dict(records(R.route_exclusives(report), "ruta", "pasos_propios"))
    assert exclusives == {"Ruta A": K.NO_EXCLUSIVE_STEPS, "Ruta B": K.NO_EXCLUSIVE_STEPS, "Ruta C": "three"}
    ends = R.best_and_worst(report)
    assert records(ends, "mejor_ruta", "peor_ruta", "brecha_pp") == [("Ruta A", "Ruta B", 100.0)]
    assert C.compare_ends(ends).first().z > 0


def test_single_route_has_no_test(spark):
    t, c = touches(spark, [("a", 1, "sms")]), conversions(spark, [("a", 1)])
    report = R.route_report(t, A.attribution_detail(A.conversion_owners(t, c)))
    tested = C.compare_ends(R.best_and_worst(report)).first()
    assert tested.z is None and tested.p is None


def test_sum_of_routes_is_all_subjects(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(200)}", rng.randrange(5), "sms", f"st{rng.randrange(3)}") for _ in range(600)]
    t = touches(spark, rows)
    total = R.routes(t).agg(F.sum("msisdn_en_ruta")).first()[0]
    assert total == len({r[0] for r in rows})


def test_ordinal_equals_sorting(spark):
    """Names of every length, many alike in their first characters, many of one size."""
    rng = random.Random(9)
    names = {" > ".join(rng.choice(["ab", "a", "a!", "é", "STEP 1", "STEP 10"]) for _ in range(rng.randrange(1, 40))) for _ in range(2000)}
    names |= {"x" * 96 + str(i) for i in range(300)} | {"", "x" * 24, "x" * 96}
    rows = [(f"g{rng.randrange(3)}", rng.choice([1, 1, 1, 2, rng.randrange(40)]), k) for k in sorted(names)]
    df = spark.createDataFrame(rows, "g string, n int, k string").repartition(7)
    got = size_ordinal(df, "g", "n", "k", "pos")
    expected = []
    for g in ("g0", "g1", "g2"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))
        expected += [(g, i + 1, r[2]) for i, r in enumerate(mine)]
    assert records(got, "g", "pos", "k") == sorted(expected)


def test_route_report_leaves_the_winner_out_and_makes_runs_once_a_route(spark):
    """Routes need days and counts: no task looks for a day's winning touch, and runs are made of distinct lists of sends."""
    t, c = touches(spark, TOUCHES), conversions(spark, [("a", 4), ("b", 3), ("c", 2)])
    report = R.route_report(t, A.attribution_detail(A.conversion_owners(t, c)))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "prioridad" not in plan and "ganador" not in plan
    assert re.search(r"keys=\[wave#\d+, pasos#\d+, veces#\d+", plan)
    assert records(report, "ruta_key", "msisdn_impactados", "toques_prom") == [
        ("one > one > two", 1, None), ("one > three", 1, 2.0), ("one > two", 2, 2.0),
    ]


def test_routes_equal_plain_counting(spark):
    """Lists of sends that differ by day and spell the same are one route, with the sums of all their subjects."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(150)}", rng.randrange(4), "sms", f"st{rng.randrange(2)}") for _ in range(600)]
    sold = [(f"s{i}", rng.randrange(6)) for i in range(0, 150, 2)]
    t, c = touches(spark, rows), conversions(spark, sold)
    detail = A.attribution_detail(A.conversion_owners(t, c))
    for once in (False, True):
        spelled = {}
        for s in {r[0] for r in rows}:
            mine = sorted((r[1], r[3]) for r in rows if r[0] == s)
            spelled[s] = " > ".join(step for _, step in (sorted(set(mine)) if once else mine))
        credit = {r[K.SUBJECT]: r for r in detail.groupBy(K.SUBJECT).agg(F.count("*").alias("conv")).collect()}
        expected = {}
        for s, route in spelled.items():
            reached, converted = expected.get(route, (0, 0))
            expected[route] = (reached + 1, converted + (s in credit))
        got = R.route_report(t, detail, once).collect()
        assert {r.ruta_key: (r.msisdn_impactados, r.msisdn_convertidos) for r in got} == expected
        assert {r.ruta_key: r.msisdn_en_ruta for r in R.routes(t, once).collect()} == {k: v[0] for k, v in expected.items()}


def test_building_a_route_report_starts_no_job(spark, sf_dir):
    spark.sparkContext.setJobGroup("build-routes", "routes")
    j = V.events_journey(spark, sf_dir)
    report = R.best_and_worst(R.route_report(j.touches, j.attribution))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build-routes")
    assert "RangePartitioning" not in report._jdf.queryExecution().optimizedPlan().toString()
    spark.sparkContext.setJobGroup("other", "")


def test_top_per_group(spark):
    df = spark.createDataFrame([("g", i) for i in range(10)] + [("h", 1)], "g string, n int")
    assert records(top_per_group(df, ["g"], [F.col("n").desc()], 2), "g", "n") == [("g", 8), ("g", 9), ("h", 1)]
