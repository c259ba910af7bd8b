from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import conversions, day, executed_plan, records, touches
from touchpath import Journey, JourneyConfig
from touchpath import constants as K
from touchpath.operators import compare as C
from touchpath.operators import composition as CO
from touchpath.operators import quality as Q
from touchpath.plans import reports as P
from touchpath.plans import semantic as M


@pytest.fixture(scope="module")
def journey(spark):
    """Two waves; every subject gets each step once, as in a designed journey."""
    rng = random.Random(3)
    t, c = None, None
    for wave in ("a", "b"):
        sends = [
            (f"{wave}{s}", 3 * step + rng.randrange(2), ["sms", "push"][step % 2], f"step{step}")
            for s in range(40) for step in range(rng.randrange(1, 5))
        ]
        sales = sorted({(f"{wave}{rng.randrange(60)}", rng.randrange(25), f"C{rng.randrange(4)}") for _ in range(60)})
        tw, cw = touches(spark, sends, wave), conversions(spark, sales, wave)
        t, c = (tw, cw) if t is None else (t.unionByName(tw), c.unionByName(cw))
    return Journey(t.cache(), c.cache(), JourneyConfig(("a", "b")))


def totals(df, column):
    return dict(records(df.groupBy(K.WAVE).agg(F.sum(column).alias("n")), K.WAVE, "n"))


def test_invariants_between_reports(journey):
    j = journey
    kpi = {r.wave: r for r in P.kpi_report(j.touches, j.owners).collect()}
    step = P.step_report(j.touches, j.attribution)
    assert totals(step, "msisdn_impactados") == {w: k.envios for w, k in kpi.items()}
    credited = j.attribution.groupBy(K.WAVE, K.STEP, K.CHANNEL, K.SUBJECT).count().groupBy(K.WAVE).count()
    assert totals(step, "msisdn_convertidos") == dict(records(credited, K.WAVE, "count"))
    composed = CO.composition(j.attribution, j.conversions)
    for dim in K.CONVERSION_ATTRS:
        one = composed.where(F.col("dimension") == dim)
        assert totals(one, "conv_atribuidas") == {w: k.conversiones for w, k in kpi.items()}
        assert totals(one, "reno_base") == {w: k.reno_periodo for w, k in kpi.items()}
    indices = step.groupBy(K.WAVE).agg(F.max("paso_idx").alias("n"))
    assert dict(records(indices, K.WAVE, "n")) == {w: k.pasos for w, k in kpi.items()}
    for report in (P.latency_distribution, P.touch_distribution, P.channel_share, P.channel_by_sales_channel):
        assert totals(report(j.attribution), "conv") == {w: k.conversiones for w, k in kpi.items()}
    assert j.attribution.where("dias_al_convertir < 0").isEmpty()
    last = P.cumulative_by_relative_day(j.touches, j.attribution).groupBy(K.WAVE).agg(
        F.max("acum").alias("n"), F.max("pct").alias("p"))
    assert records(last, K.WAVE, "n", "p") == sorted((w, k.conversiones, 100.0) for w, k in kpi.items())
    quality = {r.wave: r for r in Q.quality_report(j.touches, j.conversions, j.owners).collect()}
    for w, k in kpi.items():
        assert quality[w].msisdn_envio == k.impactados and quality[w].atribuciones == k.conversiones


def test_step_without_conversion_stays(spark):
    t = touches(spark, [("a", 1, "sms", "first"), ("b", 4, "push", "second")])
    j = Journey(t, conversions(spark, [("a", 2)]), JourneyConfig(("w",)))
    rows = records(P.step_report(j.touches, j.attribution), "paso_idx", K.STEP, "dia_rel", "msisdn_convertidos", "tasa_pct")
    assert rows == [(1, "first", 0, 1, 100.0), (2, "second", 3, 0, 0.0)]
    assert records(P.top_step(P.step_report(j.touches, j.attribution)), K.STEP) == [("first",)]


def test_base_only_values_stay_with_zero(spark):
    j = Journey(touches(spark, [("a", 1, "sms")]), conversions(spark, [("a", 1, "X"), ("z", 1, "Y")]), JourneyConfig(("w",)))
    rows = records(CO.composition(j.attribution, j.conversions, ["ciudad"]), "valor", "conv_atribuidas", "reno_base", "pct_base", "indice")
    assert rows == [("X", 1, 1, 50.0, 200.0), ("Y", 0, 1, 50.0, 0.0)]


def test_support_falls_back_to_the_largest(journey):
    composed = CO.composition(journey.attribution, journey.conversions, ["ciudad"])
    assert CO.with_support(composed, 1).where("conv_atribuidas < 1").isEmpty()
    assert CO.with_support(composed, 10**6, 2).groupBy(K.WAVE).count().where("count <> 2").isEmpty()
    assert CO.top_values(composed, 1).count() == 2


def test_weekdays_are_complete(spark, journey):
    week = P.weekday_distribution(spark, journey.attribution, ("a", "b", "empty"))
    assert week.count() == 21
    assert records(week.where("wave = 'empty'"), "conv", "pct") == [(0, 0.0)] * 7


def test_waves_share_the_category_list(journey):
    composed = CO.composition(journey.attribution, journey.conversions, ["ciudad"])
    top = C.top_across_waves(composed, ("a", "b", "empty"), 2)
    assert top.count() == 6 and top.where("conv_atribuidas is null").isEmpty()
    dense = C.dense_by_wave(P.channel_share(journey.attribution), ("a", "b", "empty"), [K.CHANNEL], ["conv", "pct"])
    assert dense.where("wave = 'empty' and conv <> 0").isEmpty() and dense.where("wave = 'empty'").count() >= 1
    rates = C.compare_rates(P.kpi_report(journey.touches, journey.owners), "a", "b").first()
    assert rates.brecha_pp == pytest.approx(rates.tasa_a - rates.tasa_b, abs=0.005)


def test_approximate_reach_is_close(journey):
    exact = {r[:2]: r[2] for r in records(journey.touches.groupBy(K.WAVE, K.CHANNEL).agg(F.countDistinct(K.SUBJECT).alias("n")), K.WAVE, K.CHANNEL, "n")}
    for wave, channel, n in records(P.approximate_reach(journey.touches, [K.CHANNEL]), K.WAVE, K.CHANNEL, "msisdn_aprox"):
        assert n == pytest.approx(exact[(wave, channel)], rel=0.1)


def test_gates(spark, journey):
    t, c = touches(spark, [("a", 1, "sms")]), conversions(spark, [("b", 1)])
    Q.require_rows(t, "touch")
    with pytest.raises(Q.QualityError, match="no valid touch"):
        Q.require_rows(t.limit(0), "touch")
    with pytest.raises(Q.QualityError, match="'a'.*'b'"):
        Q.require_overlap(t, c)
    j = Journey(t, c, JourneyConfig(("w",)))
    with pytest.raises(Q.QualityError, match="last-touch limit"):
        Q.require_attributions(j.attribution, t, c, 7)
    Q.require_overlap(journey.touches, journey.conversions)
    Q.require_attributions(journey.attribution, journey.touches, journey.conversions, 7)


def test_measures_meet_on_shared_axes(journey):
    facts = {"touches": journey.touches, "conversions": journey.conversions, "attribution": journey.attribution}
    by_channel = M.evaluate(facts, ["impactados", "convertidos", "tasa_conversion"], [K.WAVE, K.CHANNEL], rows_from="touches")
    for r in by_channel.collect():
        assert r.tasa_conversion == pytest.approx(r.convertidos / r.impactados)
    sliced = M.evaluate(facts, ["envios_totales"], slicers=M.Slicers({K.CHANNEL: ["sms"]}, dates=(day(0), day(5))))
    expected = journey.touches.where((F.col(K.CHANNEL) == "sms") & F.col(K.TOUCH_DATE).between(day(0), day(5)))
    assert dict(records(sliced, K.WAVE, "envios_totales")) == dict(records(expected.groupBy(K.WAVE).count(), K.WAVE, "count"))
    gap = M.measure_by_wave(M.evaluate(facts, ["tasa_conversion"]), "tasa_conversion", ("a", "b")).first()
    assert gap.brecha_pp == pytest.approx(100 * (gap.tasa_conversion_a - gap.tasa_conversion_b))
    share = M.percent_of_wave(M.evaluate(facts, ["renovaciones_atribuidas"], [K.WAVE, K.CHANNEL]), "renovaciones_atribuidas")
    assert [round(v, 9) for v in totals(share, "pct_wave").values()] == [1.0, 1.0]


def test_calendar_and_dimensions(spark, journey):
    t, c = touches(spark, [("a", 0, "sms")]), conversions(spark, [("a", 6)])
    days = M.calendar(t, c)
    assert [r.dia_semana_nombre for r in days.orderBy("date").collect()] == list(K.WEEKDAYS_ACCENTED)
    assert records(M.step_dimension(t), "clave_paso") == [("w|s1",)]
    rel = M.with_relative_day(journey.attribution, journey.touches, ("a",))
    assert rel.count() == journey.attribution.count()
    assert rel.where("wave = 'b' and dia_rel_conv is not null").isEmpty()


def test_dimension_slicers_reach_every_fact_with_the_key(journey):
    j = journey
    facts = {"touches": j.touches, "conversions": j.conversions, "attribution": j.attribution}
    days, steps = M.days(j.touches, j.conversions), M.steps(j.touches)
    early = M.Slicers(attributes=[(steps, F.col("paso_idx") <= 2), (days, F.col("dia_semana_num") <= 5)])
    names = ["impactados", "renovaciones_atribuidas", "renovaciones_periodo"]
    got = {r.wave: tuple(r)[1:] for r in M.evaluate(facts, names, slicers=early).collect()}
    first = {(r.wave, r[K.STEP]) for r in P.step_order(j.touches).where("paso_idx <= 2").collect()}
    for wave in ("a", "b"):
        reached = {r[K.SUBJECT] for r in j.touches.collect() if r.wave == wave and (wave, r[K.STEP]) in first and r[K.TOUCH_DATE].isoweekday() <= 5}
        credited = [r for r in j.attribution.collect() if r.wave == wave and (wave, r[K.STEP]) in first and r[K.CONV_DATE].isoweekday() <= 5]
        sold = [r for r in j.conversions.collect() if r.wave == wave and r[K.CONV_DATE].isoweekday() <= 5]
        assert got[wave] == (len(reached), len(credited), len(sold))
    with pytest.raises(ValueError, match="no fact has the dimension's key"):
        M.evaluate({"conversions": j.conversions}, ["renovaciones_periodo"], slicers=M.Slicers(attributes=[(steps, F.lit(True))]))


def test_dimension_slicers_prune_stored_partitions(spark, tmp_path, journey):
    """A slicer on a dimension whose key partitions the fact reads only the partitions of its members."""
    path = str(tmp_path / "touches")
    journey.touches.write.partitionBy(K.WAVE).parquet(path)
    stored = spark.read.schema(journey.touches.schema).parquet(path)
    waves = M.Dimension(spark.createDataFrame([("a", "A"), ("b", "B")], "wave string, etiqueta string"), (K.WAVE,))
    sliced = M.Slicers(attributes=[(waves, F.col("etiqueta") == "A")]).apply(stored, "touches")
    assert "dynamicpruning" in executed_plan(sliced).lower()
    assert records(sliced.select(K.WAVE).distinct(), K.WAVE) == [("a",)]


def test_composition_measures_have_their_own_denominators(journey):
    j = journey
    facts = {"touches": j.touches, "conversions": j.conversions, "attribution": j.attribution}
    got = M.evaluate(facts, ["pct_atribuido", "pct_base", "indice_composicion"], [K.WAVE, "ciudad"]).collect()
    want = {(r.wave, r.valor): r for r in CO.composition(j.attribution, j.conversions, ["ciudad"]).collect()}
    for r in got:
        published = want[r.wave, r.ciudad]
        assert round(100 * (r.pct_atribuido or 0), 2) == pytest.approx(published.pct_atribuido, abs=0.011)
        assert round(100 * r.pct_base, 2) == pytest.approx(published.pct_base, abs=0.011)
        assert r.indice_composicion is None or round(r.indice_composicion) == pytest.approx(published.indice, abs=1)
    with pytest.raises(ValueError, match="whole wave"):
        M.evaluate(facts, ["pct_base"], ["ciudad"])


def test_sketches_of_days_merge(spark):
    rows = spark.range(60_000).selectExpr("'w' AS wave", "cast(id % 20000 as string) AS msisdn", "date_add(date'2026-06-01', cast(id % 9 as int)) AS fecha_envio", "if(id % 3 = 0, 'sms', 'push') AS canal")
    sketches = P.reach_sketches(rows)
    assert sketches.count() == 9
    part = rows.where("fecha_envio >= date'2026-06-03' AND fecha_envio < date'2026-06-08'")
    for keys in ([K.CHANNEL], []):
        exact = {tuple(r)[:-1]: r.n for r in part.groupBy(K.WAVE, *keys).agg(F.countDistinct(K.SUBJECT).alias("n")).collect()}
        got = {tuple(r)[:-1]: r.msisdn_aprox for r in P.reach_of_interval(sketches, day(2), day(7), keys).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] / exact[k] - 1) < 0.02 for k in exact)
