from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import conversions, day, records, touches
from touchpath import constants as K
from touchpath.operators import attribution as A
from touchpath.operators.windows import period_bounds, validity_windows


def detail(spark, t, c, **options):
    owners = A.conversion_owners(touches(spark, t), conversions(spark, c), **options)
    return A.attribution_detail(owners)


def owners_of(spark, t, c, **options):
    return [
        ((c_day - day(0)).days, (t_day - day(0)).days, channel)
        for c_day, t_day, channel in records(detail(spark, t, c, **options), K.CONV_DATE, K.TOUCH_DATE, K.CHANNEL)
    ]


def test_window_borders(spark):
    t = [("s", 1, "sms"), ("s", 4, "sms")]
    c = [("s", n) for n in (0, 1, 3, 4, 10, 11)]
    assert owners_of(spark, t, c) == [(1, 1, "sms"), (3, 1, "sms"), (4, 4, "sms"), (10, 4, "sms")]


def test_gap_longer_than_the_limit_stays_open_before_the_next_touch(spark):
    t, c = [("s", 1, "sms"), ("s", 20, "sms")], [("s", 15)]
    assert owners_of(spark, t, c) == [(15, 1, "sms")]
    assert owners_of(spark, t, c, cap_all=True) == []


def test_priority_decides_the_day(spark):
    t, c = [("s", 1, "whatsapp"), ("s", 1, "push")], [("s", 1)]
    assert owners_of(spark, t, c) == [(1, 1, "push")]
    assert owners_of(spark, t, c, priority=K.CHANNEL_PRIORITY_FIRST_VERSION) == [(1, 1, "whatsapp")]
    assert owners_of(spark, t, c, tie_policy="merge") == [(1, 1, "push+whatsapp")]
    assert records(detail(spark, t, c), "canales_mismo_dia", "toques_previos") == [(2, 2)]


def test_records_sharing_a_day(spark):
    t = touches(spark, [("s", 1, "sms"), ("s", 1, "push")])
    c = conversions(spark, [("s", 2, "B"), ("s", 2, "A")])
    owners = A.conversion_owners(t, c)
    assert records(A.attribution_detail(owners), "ciudad", "canales_mismo_dia") == [("A", 2)]
    assert records(A.attribution_detail(owners, "records"), "canales_mismo_dia") == [(4,)]
    assert records(A.attribution_per_record(owners, c), "ciudad", "toques_previos") == [("A", 2), ("B", 2)]


def test_waves_do_not_mix(spark):
    t = touches(spark, [("s", 1, "sms")], "a").unionByName(touches(spark, [("s", 2, "sms")], "b"))
    c = conversions(spark, [("s", 3)], "a")
    got = records(A.attribution_detail(A.conversion_owners(t, c)), K.WAVE, K.TOUCH_DATE)
    assert got == [("a", day(1))]


def test_unknown_options_are_refused(spark):
    t, c = touches(spark, [("s", 1, "sms")]), conversions(spark, [("s", 1)])
    with pytest.raises(ValueError):
        A.conversion_owners(t, c, tie_policy="first")
    with pytest.raises(ValueError):
        A.attribution_detail(A.conversion_owners(t, c), "pairs")


def test_windows_table(spark):
    t = touches(spark, [("s", 1, "sms"), ("s", 1, "push"), ("s", 20, "sms")])
    assert records(validity_windows(t), K.TOUCH_DATE, "fin_ventana") == [(day(1), day(20)), (day(20), day(27))]
    capped = records(validity_windows(t, cap_all=True), K.TOUCH_DATE, "fin_ventana")
    assert capped == [(day(1), day(8)), (day(20), day(27))]


def test_period_spans_both_facts(spark):
    t, c = touches(spark, [("s", 3, "sms"), ("s", 5, "sms")]), conversions(spark, [("s", 1), ("s", 9)])
    assert records(period_bounds(t, c), "desde", "hasta", "dia_cero") == [(day(1), day(10), day(3))]


def brute_force(t, c, limit):
    """The rule stated row by row: intervals, then rank by day, priority and text order."""
    result = {}
    for subject, c_day, *_ in c:
        mine = [x for x in t if x[0] == subject]
        days = sorted({x[1] for x in mine})
        for i, start in enumerate(days):
            end = days[i + 1] if i + 1 < len(days) else start + limit
            if start <= c_day < end:
                same_day = [x for x in mine if x[1] == start]
                winner = min(same_day, key=lambda x: (K.CHANNEL_PRIORITY.get(x[2], 99), *x[2:]))
                before = sum(1 for x in mine if x[1] <= c_day)
                result[(subject, c_day)] = (start, *winner[2:], c_day - start, len(same_day), before)
    return result


@pytest.mark.parametrize("seed, limit", [(1, 7), (2, 3), (3, 1)])
def test_equals_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    # One subject holds about a third of everything.
    pick = lambda: "hot" if rng.random() < 0.34 else f"s{rng.randrange(25)}"
    t = [
        (pick(), rng.randrange(40), rng.choice(["sms", "push", "fax"]), f"st{rng.randrange(4)}", f"v{rng.randrange(2)}",
         f"a{rng.randrange(5)}")
        for _ in range(600)
    ]
    c = [(pick(), rng.randrange(50), f"C{rng.randrange(3)}") for _ in range(300)]
    owners = A.conversion_owners(touches(spark, t), conversions(spark, list(dict.fromkeys(c))), limit)
    got = {
        (r.msisdn, (r.fecha_conv - day(0)).days): (
            (r.fecha_envio - day(0)).days, r.canal, r.canvas_step_nm, r.canvas_variation_nm, r.cuenta_id,
            r.dias_al_convertir, r.canales_mismo_dia, r.toques_previos,
        )
        for r in A.attribution_detail(owners).collect()
    }
    assert got == brute_force(t, c, limit)
    cities = {}
    for subject, n, city in c:
        cities.setdefault((subject, n), set()).add(city)
    for r in A.attribution_detail(owners).collect():
        assert r.ciudad == min(cities[(r.msisdn, (r.fecha_conv - day(0)).days)])
    # The diagnostics derived from owners equal the joins that define them.
    tf, cf = touches(spark, t), conversions(spark, list(dict.fromkeys(c)))
    attribution = A.attribution_detail(owners)
    counts = A.ownership_counts(owners).first()
    assert counts.atribuciones == attribution.count()
    assert counts.sin_atribuir == A.unattributed(cf, attribution).count()
    assert counts.fuera_de_ventana == A.out_of_window(cf, tf, attribution).count()
    assert counts.empates == attribution.where("canales_mismo_dia > 1").count()


def test_owning_window_contains_the_conversion(spark):
    t = touches(spark, [("s", 1, "sms"), ("s", 9, "sms"), ("r", 2, "sms")])
    c = conversions(spark, [("s", 5), ("s", 9), ("r", 30)])
    owned = A.owning_windows(A.conversion_owners(t, c), validity_windows(t))
    assert owned.count() == 2
    inside = (F.col(K.CONV_DATE) >= F.col(K.TOUCH_DATE)) & (F.col(K.CONV_DATE) < F.col("fin_ventana"))
    assert owned.where(~inside).isEmpty()


@pytest.mark.parametrize("cap_all", [False, True])
def test_batches_give_what_one_run_gives(spark, cap_all):
    """Gaps beyond the limit, subjects first touched after they converted, touches and conversions in any batch."""
    rng = random.Random(4)
    t = [(f"s{rng.randrange(40)}", rng.randrange(60), rng.choice(["sms", "push", "x"])) for _ in range(160)]
    c = sorted({(f"s{rng.randrange(50)}", rng.randrange(70), rng.choice("AB")) for _ in range(260)})
    whole = A.conversion_owners(touches(spark, t), conversions(spark, c), 5, cap_all=cap_all)
    owners = state = None
    for since, until in ((0, 15), (15, 16), (16, 40), (40, 80)):
        batch = touches(spark, [r for r in t if since <= r[1] < until]), conversions(spark, [r for r in c if since <= r[1] < until])
        if owners is None:
            owners, state = A.conversion_owners(*batch, 5, cap_all=cap_all), A.last_touch_state(batch[0])
        else:
            owners = A.extended_owners(owners, state, *batch, 5, cap_all=cap_all)
            state = A.last_touch_state(batch[0], before=state)
        owners, state = (spark.createDataFrame(df.collect(), df.schema) for df in (owners, state))
    columns = [K.SUBJECT, K.CONV_DATE, "variantes", "impactado"]
    texts = [F.coalesce(F.col(x).cast("string"), F.lit("-")).alias(x) for x in ("toque", "toques_previos", "conversion")]
    assert records(owners.select(*columns, *texts), *columns, "toque", "toques_previos", "conversion") == records(
        whole.select(*columns, *texts), *columns, "toque", "toques_previos", "conversion"
    )
