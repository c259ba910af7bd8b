from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import conversions, executed_plan, records, touches
from touchpath import Journey, JourneyConfig
from touchpath import constants as K
from touchpath import schemas
from touchpath import sources as S
from touchpath.operators.quality import QualityError
from touchpath.plans.extraction import export_events, split_unmatched, wave_touches, write_export

KEYS = ("second", "first")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Partitioned tables: a DATE-partitioned channel, a text-partitioned one, profiles and sales."""
    root = tmp_path_factory.mktemp("lake")
    events = spark.range(300).select(
        F.lit("gt").alias("instance_tp"), F.lit("send").alias("event_tp"),
        F.date_add(F.lit(dt.date(2026, 6, 1)), (F.col("id") % 30).cast("int")).alias("date_send_dt"),
        F.when(F.col("id") % 2 == 0, " Camp-A").otherwise("camp-b").alias("campaign_id"),
        (F.col("id") % 12).cast("string").alias("external_user_id"),
        F.lit("s").alias("canvas_step_id"), F.lit("step").alias("canvas_step_nm"),
        F.lit(None).cast("string").alias("canvas_variation_nm"), F.col("id").cast("string").alias("event_id"),
        F.lit("canvas").alias("campaign_type"),
        F.element_at(F.array(F.lit("SMS"), F.lit("Bridge"), F.lit("WhatsApp")), (F.col("id") % 3 + 1).cast("int")).alias("step_name"),
    ).withColumn("dt", F.col("date_send_dt"))
    events.write.partitionBy("dt").parquet(f"{root}/webhook")
    events.drop("step_name").write.partitionBy("dt").parquet(f"{root}/email")
    spark.range(20).select(
        F.when(F.col("id") < 6, F.col("id").cast("string")).alias("first"),
        F.when(F.col("id") >= 4, F.col("id").cast("string")).alias("second"),
        F.concat(F.lit("5020000000"), F.col("id")).alias("msisdn"), F.lit("gt").alias("cntry_cd"),
        F.explode(F.array(*[F.lit(f"2026-06-{n:02d}") for n in (1, 15, 29)])).alias("fct_dt"),
    ).write.partitionBy("fct_dt").parquet(f"{root}/profile")
    spark.range(200).select(
        F.date_add(F.lit(dt.date(2026, 5, 1)), (F.col("id") % 120).cast("int")).alias("evnt_dt"),
        F.lit("RENOVACION").alias("evnt_typ"), F.col("id").cast("string").alias("msisdn_dd"),
        F.lit("x").alias("ar_sscrbr_dd"), F.when(F.col("id") % 4 > 0, "MOBILE").otherwise("HOME").alias("sb_bs_un"),
        F.lit("HOME").alias("mv_bs_un"), F.lit("FACTURABLE").alias("bllbl_cd"),
    ).withColumn("fct_dt", F.trunc("evnt_dt", "MM")).write.partitionBy("fct_dt").parquet(f"{root}/sales")

    def read(name, text=()):
        fields = spark.read.parquet(f"{root}/{name}").schema
        types = {f.name: "string" if f.name in text else f.dataType.simpleString() for f in fields}
        return spark.read.schema(", ".join(f"`{n}` {t}" for n, t in types.items())).parquet(f"{root}/{name}")

    return {
        "webhook": S.ChannelSource("webhook", read("webhook"), has_step_name=True),
        "mixed": S.ChannelSource("webhook", read("webhook"), has_step_name=True, mixed_channels=("sms", "whatsapp")),
        "email": S.ChannelSource("email", read("email", ["dt"]), partition_type="string"),
        "profile": read("profile", ["fct_dt"]),
        "sales": read("sales"),
    }


SINCE, UNTIL = dt.date(2026, 6, 5), dt.date(2026, 6, 8)


@pytest.mark.parametrize("name", ["webhook", "email"])
def test_partitions_are_pruned_in_the_columns_own_type(spark, lake, name):
    scanned = S.scan_channel(spark, lake[name], SINCE, UNTIL, "gt")
    assert records(scanned.select("date_send_dt").distinct(), "date_send_dt") == [
        (SINCE + dt.timedelta(days=i),) for i in range(3)
    ]
    assert "PartitionFilters: [isnotnull(dt" in executed_plan(scanned)


def test_logical_date_scan_prunes_nothing(spark, lake):
    scanned = S.scan_channel(spark, lake["webhook"], SINCE, UNTIL, logical_date=True)
    assert "PartitionFilters: []" in executed_plan(scanned)
    assert scanned.select("date_send_dt").distinct().count() == 4


def test_snapshots_and_months_are_pruned(spark, lake):
    days = S.snapshot_dates(29, dt.date(2026, 6, 30))
    assert days == ["2026-06-01", "2026-06-16", "2026-06-29"]
    profile = S.scan_profile(spark, lake["profile"], days, "gt", KEYS)
    assert "PartitionFilters: [fct_dt" in executed_plan(profile)
    assert records(S.snapshot_counts(profile), "fct_dt", "filas") == [("2026-06-01", 20), ("2026-06-29", 20)]
    sales = S.scan_sales(spark, lake["sales"], dt.date(2026, 6, 20), dt.date(2026, 8, 8))
    assert "fct_dt" in executed_plan(sales).split("PartitionFilters:")[1].split("]")[0]
    assert sales.where((F.col("evnt_dt") < "2026-06-20") | (F.col("evnt_dt") >= "2026-08-08")).isEmpty()
    conditional = S.scan_sales(spark, lake["sales"], dt.date(2026, 6, 20), dt.date(2026, 8, 8), conditional_unit=True)
    assert records(conditional, "msisdn_dd") == records(sales, "msisdn_dd")
    assert S.sales_conversions(sales.unionByName(sales)).count() == S.sales_conversions(sales).count()


def test_only_needed_columns_are_read(spark, lake):
    plan = executed_plan(S.channel_touches(spark, lake["mixed"], SINCE, UNTIL, "gt", ["CAMP-A "]))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "event_id" not in schema and "canvas_step_id" not in schema


def test_mixed_table_and_campaigns(spark, lake):
    all_days = (dt.date(2026, 6, 1), dt.date(2026, 7, 1))
    got = S.channel_touches(spark, lake["mixed"], *all_days, "gt", ["CAMP-A "])
    assert records(got.groupBy("canal").count(), "canal", "count") == [("sms", 50), ("whatsapp", 50)]


def test_union_pads_and_casts(spark, lake):
    union = S.union_channels(spark, [lake["email"], lake["webhook"]], SINCE, UNTIL)
    assert tuple(union.columns) == schemas.CHANNEL_COLUMNS
    assert set(dict(union.dtypes).values()) == {"string"}
    assert union.where("canal = 'email' and step_name is not null").isEmpty()
    assert "Exchange" not in executed_plan(union)


def test_export_keeps_every_event(spark, lake, tmp_path):
    events = export_events(
        spark, [lake["email"], lake["webhook"]], lake["profile"], 29, KEYS, dt.date(2026, 6, 30), country="gt"
    )
    assert tuple(events.columns) == schemas.EXPORT_COLUMNS
    assert events.count() == 580
    matched, unmatched = split_unmatched(events)
    assert matched.count() + unmatched.count() == 580
    write_export(events, str(tmp_path / "export"))
    assert spark.read.parquet(str(tmp_path / "export")).count() == 580
    resolved = wave_touches(spark, [lake["mixed"]], S.scan_profile(spark, lake["profile"], ["2026-06-01"], "gt", KEYS), SINCE, UNTIL, KEYS)
    assert resolved.count() == resolved.distinct().count() > 0


def test_text_csv_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("msisdn,fecha_conv,ciudad\n050200000001,2026-06-07,\"San José, \"\"Centro\"\"\"\n", encoding="utf-8")
    read = S.read_text_csv(spark, str(path), ["msisdn", "fecha_conv", "ciudad"])
    assert records(read, *read.columns) == [("050200000001", "2026-06-07", 'San José, "Centro"')]
    inferred = S.read_inferred_csv(spark, str(path))
    assert dict(inferred.dtypes)["msisdn"] == "bigint"
    semicolon = tmp_path / "latin.csv"
    semicolon.write_bytes("a;b\nñ;2\n".encode("latin-1"))
    assert records(S.read_text_csv(spark, str(semicolon), ["a", "b"], ";", "ISO-8859-1"), "a", "b") == [("ñ", "2")]


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("w", "ciudad", 'a "b", c', 1)], "wave string, dimension string, valor string, n int")
    S.write_dimension_csv(df, str(tmp_path / "dims"))
    part = next((tmp_path / "dims" / "wave=w" / "dimension=ciudad").glob("*.csv"))
    assert part.read_text().splitlines()[0] == "valor,n"
    assert records(S.read_text_csv(spark, str(part), ["valor", "n"]), "valor", "n") == [('a "b", c', "1")]
    S.write_csv(df, str(tmp_path / "plain"))
    assert spark.read.csv(str(tmp_path / "plain"), header=True).count() == 1


def test_literals_and_dimension_scans(spark):
    waves = S.wave_dimension(spark, [("a", "A", "#1"), ("b", "B", "#2")])
    assert records(waves, "wave", "wave_label") == [("a", "A"), ("b", "B")]
    campaigns = spark.createDataFrame(
        [("1", "2026-05-03 00:00:00", "gt"), ("2", "2026-08-01 00:00:00", "gt"), ("3", "soon", "gt")],
        "campaign_id_key string, created_at_ts string, d_instance_tp string",
    )
    got = S.created_between(campaigns, dt.datetime(2026, 5, 1), dt.datetime(2026, 7, 28, 23, 59, 59), "gt", 100)
    assert records(got, "campaign_id_key") == [("1",)]
    assert S.lookup_campaigns(campaigns, ["2", "9"], "gt").count() == 1
    assert S.preview(campaigns, ["campaign_id_key"], 2).count() == 2
    assert S.existing_snapshots(campaigns.withColumn("fct_dt", F.lit("d"))).count() == 1


def test_materialized_journey_reads_the_same(spark, tmp_path):
    t = touches(spark, [("s", 1, "sms"), ("s", 4, "push")], "2026")
    c = conversions(spark, [("s", 2), ("s", 30)], "2026")
    model = Journey(t, c, JourneyConfig(("2026",)))
    stored = model.materialize(str(tmp_path / "model"))
    columns = schemas.ATTRIBUTION.fieldNames()
    assert records(stored.attribution, *columns) == records(model.attribution, *columns)
    assert schemas.require(stored.attribution, schemas.ATTRIBUTION, "attribution").count() == 1
    assert stored.owners.count() == 2
    assert dict(stored.touches.dtypes)[K.WAVE] == "string"


def test_replacing_partitions_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "export")
    first = spark.createDataFrame([("sms", "d1", 1), ("sms", "d2", 2), ("push", "d1", 3)], "canal string, dia string, n int")
    for _ in range(2):
        S.replace_partitions(first, path, ["canal", "dia"])
    assert records(spark.read.parquet(path), "canal", "dia", "n") == [("push", "d1", 3), ("sms", "d1", 1), ("sms", "d2", 2)]
    S.replace_partitions(first.where("canal = 'sms' AND dia = 'd2'").withColumn("n", F.lit(9)), path, ["canal", "dia"])
    assert records(spark.read.parquet(path), "canal", "dia", "n") == [("push", "d1", 3), ("sms", "d1", 1), ("sms", "d2", 9)]


def test_missing_snapshots_are_replaced_by_earlier_ones(spark, tmp_path):
    rows = [("2026-06-01", "gt", "1", "50200000001"), ("2026-06-09", "gt", "1", "50200000002"), ("2026-06-09", "sv", "2", "50200000003")]
    path = str(tmp_path / "profile")
    spark.createDataFrame(rows, "fct_dt string, cntry_cd string, external_id string, msisdn string").write.partitionBy("fct_dt").parquet(path)
    profile = spark.read.schema("cntry_cd string, external_id string, msisdn string, fct_dt string").parquet(path)
    wanted = ["2026-05-01", "2026-06-01", "2026-06-08", "2026-06-09", "2026-07-01"]
    assert S.choose_snapshots(profile, wanted) == dict(zip(wanted, ["2026-06-01"] * 3 + ["2026-06-09"] * 2, strict=True))
    assert records(S.nearest_snapshots(profile, wanted[:1]), "pedido", "fct_dt", "dias") == [("2026-05-01", "2026-06-01", -31)]
    read = S.scan_nearest_profile(spark, profile, ["2026-06-08"], "gt")
    assert records(read, "fct_dt", "msisdn") == [("2026-06-01", "50200000001")]
    assert "2026-06-01" in executed_plan(read).split("PartitionFilters")[1].split("]")[0]
    assert S.choose_snapshots(profile.limit(0), wanted) == {}


RAW = "wave string, msisdn string, fecha_envio string, canal string, canvas_step_nm string, canvas_variation_nm string, cuenta_id string"
RAW_SOLD = "wave string, msisdn string, fecha_conv string, channel string, ciudad string, departamento string, bfr_vc_nm string, bfr_dt_nm string"


def raw_model(spark, touched, sold, waves=("a", "b")):
    t = spark.createDataFrame([(w, k, d, "sms", "s", None, "c") for w, k, d in touched], RAW)
    c = spark.createDataFrame([(w, k, d, "x", "c", "d", "p", "q") for w, k, d in sold], RAW_SOLD)
    return Journey.from_raw(t, c, JourneyConfig(waves))


def test_gates_count_while_the_model_is_stored(spark, tmp_path):
    good = [("a", "50200000001", "2026-06-01"), ("b", "50200000002", "2026-06-01"), ("b", "12", "2026-06-01")]
    sold = [("a", "50200000001", "2026-06-02"), ("b", "50200000002", "2026-06-02")]
    model = raw_model(spark, good, sold)
    jobs = []
    for name, gates in (("with", True), ("without", False)):
        spark.sparkContext.setJobGroup(name, name)
        stored = model.materialize(str(tmp_path / name), gates)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[0] == jobs[1]  # no job, so no scan, of their own
    assert [(v.wave, v.touches_read, v.touches_valid, v.conversions_valid, v.reached, v.attributed) for v in stored.verdicts] == [("a", 1, 1, 1, 1, 1), ("b", 2, 1, 1, 1, 1)]


@pytest.mark.parametrize(
    ("touched", "sold", "message"),
    [
        ([("a", "50200000001", "2026-06-01"), ("b", "12", "2026-06-01")], [("a", "50200000001", "2026-06-02"), ("b", "50200000002", "2026-06-02")], "b: no valid touches left of 1 read"),
        ([("a", "50200000001", "2026-06-01"), ("b", "50200000002", "2026-06-01")], [("a", "50200000001", "2026-06-02"), ("b", "50200000002", "xx")], "b: no valid conversions left of 1"),
        ([("a", "50200000001", "2026-06-01"), ("b", "50200000002", "2026-06-01")], [("a", "50200000001", "2026-06-02"), ("b", "50200000009", "2026-06-02")], "b: no subject of the touches"),
        ([("a", "50200000001", "2026-06-01"), ("b", "50200000002", "2026-06-01")], [("a", "50200000001", "2026-06-02"), ("b", "50200000002", "2026-05-02")], "b: no conversion attributed"),
    ],
)
def test_one_broken_wave_stops_the_model(spark, tmp_path, touched, sold, message):
    with pytest.raises(QualityError, match=message) as stopped:
        raw_model(spark, touched, sold).materialize(str(tmp_path / "model"))
    assert "a:" not in str(stopped.value)
    assert raw_model(spark, touched, sold).materialize(str(tmp_path / "open"), gates=False).verdicts[1].problem
