from __future__ import annotations

import datetime as dt

import pytest

from conftest import records
from touchpath import constants as K
from touchpath import schemas
from touchpath.operators.cleaning import FIRST_RULES, between, clean_conversions, clean_touches, validity_counts
from touchpath.operators.windows import padded_interval


def raw_touches(spark, rows):
    return spark.createDataFrame(rows, schemas.text_schema(schemas.RAW_TOUCH_COLUMNS))


def raw_conversions(spark, rows):
    return spark.createDataFrame(rows, schemas.text_schema(schemas.RAW_CONVERSION_COLUMNS))


GOOD = ("+502 0000-0001", "acc", "2026-06-07 23:30:00.000 -0600", " SMS ", " Step 1 ", None, "c")


def test_valid_touch_is_typed_and_labelled(spark):
    clean = clean_touches(raw_touches(spark, [GOOD]), "pilot")
    assert schemas.require(clean, schemas.TOUCHES, "touches") is clean
    assert records(clean, *clean.columns) == [
        ("pilot", "00000001", dt.date(2026, 6, 7), "sms", "Step 1", K.NO_VARIATION, "acc")
    ]


@pytest.mark.parametrize("subject, date", [("123", GOOD[2]), ("", GOOD[2]), (None, GOOD[2]), (GOOD[0], "xx"), (GOOD[0], "")])
def test_invalid_rows_are_rejected_without_an_error(spark, subject, date):
    row = (subject, GOOD[1], date, *GOOD[3:])
    raw = raw_touches(spark, [row, GOOD])
    assert clean_touches(raw, "w").count() == 1
    counts = validity_counts(raw.selectExpr("*", "'w' wave"), K.TOUCH_DATE)
    assert records(counts, "leidos", "validos") == [(2, 1)]


def test_blank_labels_join_on_both_sides(spark):
    rows = [(*GOOD[:5], v, "c") for v in (None, "", "  ")]
    assert records(clean_touches(raw_touches(spark, rows), "w"), K.VARIATION) == [(K.NO_VARIATION,)] * 3


def test_first_version_rules(spark):
    rows = [("123", "a", "2026-06-07", "SMS", "", None, "c"), ("", "a", "2026-06-07", "SMS", "", None, "c")]
    clean = clean_touches(raw_touches(spark, rows), "w", FIRST_RULES)
    assert records(clean, K.SUBJECT, K.STEP, K.VARIATION) == [("123", "", K.NO_VARIATION)]


def test_conversions_collapse_only_full_duplicates(spark):
    row = ("00000001", "2026-06-07", "Store", "guatemala ", "Dep", None, "")
    other = (*row[:3], "Mixco", *row[4:])
    clean = clean_conversions(raw_conversions(spark, [row, row, other]), "w")
    assert records(clean, "ciudad", "plan_nm", "plan_detalle") == [
        ("GUATEMALA", K.NO_DATA, K.NO_DATA), ("MIXCO", K.NO_DATA, K.NO_DATA),
    ]
    assert clean_conversions(raw_conversions(spark, [row, row]), "w", distinct=False).count() == 2


def test_interval_is_half_open(spark):
    days = [GOOD[:2] + (f"2026-06-0{n}",) + GOOD[3:] for n in (1, 2, 3)]
    kept = between(clean_touches(raw_touches(spark, days), "w"), K.TOUCH_DATE, dt.date(2026, 6, 1), dt.date(2026, 6, 3))
    assert kept.count() == 2


def test_padding_runs_in_opposite_directions():
    bounds = padded_interval(dt.date(2026, 6, 1), dt.date(2026, 8, 1))
    assert bounds["touches"] == (dt.date(2026, 5, 23), dt.date(2026, 8, 1))
    assert bounds["conversions"] == (dt.date(2026, 5, 23), dt.date(2026, 8, 8))
    assert bounds["report"] == (dt.date(2026, 6, 1), dt.date(2026, 8, 1))


def test_schema_mismatch_fails_fast(spark):
    with pytest.raises(ValueError, match="fecha_envio"):
        schemas.require(raw_touches(spark, [GOOD]).selectExpr("*", "'w' wave"), schemas.TOUCHES, "touches")
