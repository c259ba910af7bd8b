from __future__ import annotations

import datetime as dt
import math

import pytest

from touchpath import constants as K
from touchpath import functions as fn


def values(spark, column, inputs, type_="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_subject_key_keeps_last_eight_digits(spark):
    raw = [
        "050200000001", "50200000001", "+502 0000-0001", "+50200000001", "-50200000001", " 50200000001", "50200000001 ",
        "50200000001\t", "\u00a050200000001", "12345678901234567890123450200000001",
    ]
    assert values(spark, fn.subject_key("x"), raw) == ["00000001"] * len(raw)
    odd = ["50200000001.0", "5e7", "123", "", None, "ext. 12", "0200000\x7f", "50200000001\x7f", "50200000001\n"]
    assert values(spark, fn.subject_key("x"), odd) == ["00000010", "57", "123", "", None, "12", "0200000", "00000001", "00000001"]


def test_suffix_key_keeps_punctuation(spark):
    assert values(spark, fn.suffix_key("x"), ["+502 0000-0001", "12"]) == ["000-0001", "12"]


def test_local_date_ignores_offset(spark):
    raw = [
        "2026-06-07 23:30:00.000 -0600", "2026-06-07", "2026/06/07 10:00", "2026-6-7", "2026-06", "2026", "xx", "",
        "2026-02-30", None, " 2026-06-07 16:00:00",
    ]
    seventh = dt.date(2026, 6, 7)
    assert values(spark, fn.local_date("x"), raw) == [
        seventh, seventh, seventh, seventh, None, None, None, None, None, None, seventh,
    ]


def test_plain_date_wants_a_full_date(spark):
    raw = ["2026-06-07", "2026-06", "2026", "2026-06-07x", "xx", None]
    assert values(spark, fn.plain_date("x"), raw) == [dt.date(2026, 6, 7)] + [None] * 5


def test_labels_replace_blank_and_null(spark):
    assert values(spark, fn.label_or("x", K.NO_VARIATION), [None, "", "  ", " a "]) == [K.NO_VARIATION] * 3 + ["a"]
    assert values(spark, fn.upper_label_or("x", K.NO_DATA), [" Guatemala", None]) == ["GUATEMALA", K.NO_DATA]


def test_priority_defaults_to_last(spark):
    rank = fn.channel_priority("x", K.CHANNEL_PRIORITY)
    assert values(spark, rank, ["push", "sms", "whatsapp", "fax", None]) == [1, 2, 3, 99, 99]


def test_route_labels_continue_after_z(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 18278, 18279]
    expected = ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert values(spark, fn.route_label("x"), numbers, "int") == [f"Ruta {e}" for e in expected]


def test_match_source_names_the_key(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), (None, None)], "p string, q string")
    got = [r[0] for r in df.select(fn.match_source("p", "q", ("first_id", "second_id"))).collect()]
    assert got == ["AMBAS", "SOLO FIRST_ID", "SOLO SECOND_ID", "NINGUNA"]


def test_rounding_scales_before_it_rounds(spark):
    got = values(spark, fn.round_half("x", 2), [0.285, 1.005, 2.5, -2.345], "double")
    expected = [math.floor(abs(v) * 100 + 0.5) / 100 * math.copysign(1, v) for v in (0.285, 1.005, 2.5, -2.345)]
    assert got == expected and got[0] == 0.28


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert [tuple(r) for r in df.select(fn.ratio("a", "b"), fn.pct("a", "b")).collect()] == [(None, None), (0.25, 25.0)]


def test_bins(spark):
    assert values(spark, fn.touches_bin("x"), [0, 1, 3, 4, 90, None], "int") == [None, "1", "3", "4+", "4+", None]
    assert values(spark, fn.latency_bin("x"), [0, 2, 7, 8], "int") == ["0", "1-2", "3-7", "8+"]


def test_weekdays(spark):
    monday = dt.date(2026, 6, 1)
    days = [monday + dt.timedelta(days=i) for i in range(7)]
    assert values(spark, fn.weekday_label("x"), days, "date") == list(K.WEEKDAYS)
    assert values(spark, fn.weekday_number("x"), days, "date") == list(range(1, 8))


def test_month_starts_include_the_tail_month():
    got = fn.month_starts(dt.date(2026, 11, 22), dt.date(2027, 1, 8))
    assert got == [dt.date(2026, 11, 1), dt.date(2026, 12, 1), dt.date(2027, 1, 1)]
    assert fn.month_starts(dt.date(2026, 6, 1), dt.date(2026, 7, 1)) == [dt.date(2026, 6, 1)]


@pytest.mark.parametrize(
    "counts", [(128, 1346, 55, 431), (10, 100, 10, 100), (0, 10, 0, 20), (5, 5, 7, 7), (1, 0, 1, 5)]
)
def test_two_proportion_test(spark, counts):
    x1, n1, x2, n2 = counts
    df = spark.createDataFrame([counts], "x1 int, n1 int, x2 int, n2 int")
    z, p = df.select(fn.two_proportion_z("x1", "n1", "x2", "n2").alias("z")).select("z", fn.two_sided_p("z")).first()
    pooled = (x1 + x2) / (n1 + n2)
    if min(n1, n2) == 0 or pooled in (0, 1):
        assert z is None and p is None
        return
    error = math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    assert z == pytest.approx((x1 / n1 - x2 / n2) / error)
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_title_case(spark):
    assert values(spark, fn.title_case("x"), ["SAN JUAN"]) == ["San Juan"]


def test_folded(spark):
    assert values(spark, fn.folded("x"), ["  SMS "]) == ["sms"]
