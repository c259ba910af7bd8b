from __future__ import annotations

import pytest

from conftest import executed_plan, records
from touchpath.functions import suffix_key
from touchpath.operators import identity as I

KEYS = ("second", "first")


@pytest.fixture(scope="module")
def profile(spark):
    rows = [
        ("d1", "1", "x1", "50200000001"), ("d2", "1", "x1", "50200000001"),
        ("d1", "2", "x2", "50200000002"), ("d1", None, "x3", "50200000003"),
        ("d1", "4", None, "50200000004"), ("d1", "9", "2", "50200000009"),
    ]
    return spark.createDataFrame(rows, "fct_dt string, first string, second string, msisdn string")


@pytest.fixture(scope="module")
def sends(spark):
    rows = [
        ("sms", "1", "2026-06-01", "c", "s", "v"), ("sms", "1", "2026-06-01", "c", "s", "v"),
        ("push", "x3", "2026-06-02", "c", "s", "v"), ("push", "2", "2026-06-02", "c", "s", "v"),
        ("sms", "nobody", "2026-06-03", "c", "s", "v"), ("sms", None, "2026-06-03", "c", "s", "v"),
    ]
    return spark.createDataFrame(
        rows, "canal string, external_user_id string, fecha_envio string, campaign_id string, "
        "canvas_step_nm string, canvas_variation_nm string"
    )


@pytest.fixture(scope="module")
def keys(profile):
    return I.identity_dictionary(profile, KEYS)


def test_dictionary_has_one_row_per_key_value(keys):
    got = {r.user_key: (r.msisdn_por_second, r.msisdn_por_first) for r in keys.collect()}
    assert got["1"] == (None, "50200000001")
    assert got["2"] == ("50200000009", "50200000002")
    assert got["x3"] == ("50200000003", None)
    assert len(got) == keys.count() == 7


def test_fallback_keeps_unmatched_rows(sends, keys):
    resolved = I.resolve(sends, keys, KEYS)
    assert resolved.count() == sends.count()
    assert resolved.where("msisdn is null").count() == 2
    assert records(resolved.where("external_user_id = '2'"), "msisdn") == [("50200000009",)]
    swapped = I.resolve(sends, keys, ("first", "second"))
    assert records(swapped.where("external_user_id = '2'"), "msisdn") == [("50200000002",)]


def test_inner_resolution_collapses_resends(sends, keys):
    got = records(I.resolve_touches(sends, keys, ["first"]), "msisdn", "cuenta_id")
    assert got == [("50200000001", "1"), ("50200000002", "2")]


def test_each_channel_by_its_own_key(sends, keys):
    got = I.resolve_by_channel(sends, keys, {"push": "second"}, "first")
    assert records(got, "msisdn", "canal") == [
        ("50200000001", "sms"), ("50200000001", "sms"), ("50200000003", "push"), ("50200000009", "push")
    ]


def test_match_diagnostics(sends, keys):
    ids = I.channel_ids(sends)
    rate = records(I.match_rate(ids, keys, {"push": "second"}, "first"), "canal", "total_ids", "con_msisdn", "pct_match")
    assert rate == [("push", 2, 2, 100.0), ("sms", 3, 1, 33.3)]
    by_key = records(I.match_by_key(ids, keys, KEYS), "canal", "match_por_second", "match_por_first", "sin_ningun_match")
    assert by_key == [("push", 2, 1, 0), ("sms", 0, 1, 2)]
    assert records(I.match_conflicts(I.all_ids(sends), keys, KEYS), "total", "matchea_ambas",
                   "matchea_ambas_con_msisdn_distinto") == [(5, 1, 1)]
    both = I.match_listing(I.all_ids(sends), keys, KEYS, only_both=True)
    assert records(both, "external_user_id") == [("2",)]
    assert I.match_listing(I.all_ids(sends), keys, KEYS, limit=2).count() == 2


def test_samples_keep_pairs_and_nulls(sends, keys):
    sample = I.sample_per_channel(I.channel_ids(sends).dropna(), keys, "first", 10)
    got = {r.canal: list(zip(r.external_user_ids, r.msisdns)) for r in sample.collect()}
    assert got["sms"] == [("1", "50200000001"), ("nobody", None)]
    assert got["push"] == [("2", "50200000002"), ("x3", None)]
    combined = I.match_rate_with_sample(I.channel_ids(sends).dropna(), keys, "first", 1)
    assert records(combined, "canal", "total_ids", "con_msisdn") == [("push", 2, 1), ("sms", 2, 1)]


def test_sample_limit_is_applied_before_the_shuffle(sends, keys):
    assert "WindowGroupLimit" in executed_plan(I.sample_per_channel(I.channel_ids(sends), keys, "first", 5))


def test_rows_and_measure(sends, keys):
    assert records(I.rows_per_channel(sends, keys, "first"), "canal", "filas") == [("push", 1), ("sms", 2)]
    measured = I.measure_before_export(sends, keys, "first").first()
    assert tuple(measured) == (3, 2, 2, "2026-06-01", "2026-06-02")


def test_profile_checks(spark, profile, sends):
    moved = profile.unionByName(spark.createDataFrame([("d2", "2", "x2", "50299999999")], profile.schema))
    assert records(I.unstable_keys(moved, "first"), "first", "msisdn_distintos") == [("2", 2)]
    assert records(I.repeated_keys(moved.unionByName(moved.limit(1)), "first"), "fct_dt", "first") != []
    assert I.repeated_keys(profile, "first").isEmpty()
    shared = profile.withColumn("msisdn", profile.msisdn.substr(1, 9))
    assert records(I.shared_subjects(sends, shared, "first"), "msisdn", "external_ids_con_envio") == [("502000000", 2)]
    coverage = I.key_coverage(I.all_ids(sends), profile, "first")
    assert tuple(coverage.first()) == (5, 2, 2)
    stacked = I.stacked_dictionaries(profile, KEYS)
    assert stacked.count() == 10 and stacked.where("user_key is null").count() == 2


def test_suffix_join(spark):
    left = spark.createDataFrame([("50200000001",), ("50200000001",), ("50200000002",)], "msisdn string")
    right = spark.createDataFrame([("00000001",), ("00000001",)], "msisdn string")
    assert records(I.suffix_matches(left, right, suffix_key), "msisdn") == [("50200000001",)]
