"""Journey inputs derived from the given tables.

Two journeys: ``events`` (users touched by view/click/signup events, converting
by purchase) and ``orders`` (orders touched by their line items, converting on
the order date). Both arrive as untidy text, the way exported files do.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpath import Journey, JourneyConfig
from touchpath.sources import ChannelSource

WAVES = ("pilot", "prod")
SNAPSHOTS = ("2024-01-01", "2024-01-16", "2024-01-29")
KEYS = ("vendor_id", "external_id")
SINCE, UNTIL = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
EVENTS = JourneyConfig(WAVES, last_touch_days=3, priority={"view": 1, "click": 2})
ORDERS = JourneyConfig(WAVES, last_touch_days=30, priority={"r": 1, "a": 2})


#: Columns of the given tables the journeys read; declared, so no job has to look for them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _wave(ts: str, split: str) -> Column:
    return F.when(F.col(ts) < F.lit(split).cast("timestamp_ntz"), WAVES[0]).otherwise(WAVES[1]).alias("wave")


def _phone(col: str) -> Column:
    return (F.col(col) + 50200000000).cast("string")


def _offset_text(col: str) -> Column:
    return F.concat(F.substring(F.col(col).cast("string"), 1, 19), F.lit(".000 -0600"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


#: What is wrong with the second copy of every 40th event, by event_id % 200.
FAULTS = {0: "short key", 40: "no key", 80: "unreadable date", 120: "no date", 160: "empty date"}


def _with_faults(events: DataFrame) -> DataFrame:
    """Every 40th event twice, the second time with a ``fault`` that cleaning must reject."""
    fault = F.element_at(F.create_map(*(F.lit(x) for kv in FAULTS.items() for x in kv)), (F.col("event_id") % 200).cast("int"))
    return events.withColumn("fault", F.explode(F.when(F.col("event_id") % 40 == 0, F.array(F.lit(None), fault)).otherwise(F.array(F.lit(None)))))


def _faulty(key: Column, day: Column) -> tuple[Column, Column]:
    no_key, no_day = F.col("fault").isin("no key"), F.col("fault").isin("no date")
    bad_key = F.when(F.col("fault").isin("short key"), "+502 123").when(~F.coalesce(no_key, F.lit(False)), key)
    bad_day = F.when(F.col("fault").isin("unreadable date"), "xx").when(F.col("fault").isin("empty date"), "").when(~F.coalesce(no_day, F.lit(False)), day)
    return bad_key, bad_day


def raw_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "signup"))
    key, day = _faulty(_phone("user_id"), _offset_text("ts"))
    return _with_faults(events).withColumn("k", _k()).select(
        _wave("ts", "2024-01-16"),
        key.alias("msisdn"),
        F.concat(F.lit("A"), F.col("event_id") % 3, F.lit("-"), F.col("user_id")).alias("cuenta_id"),
        day.alias("fecha_envio"),
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("canal"),
        F.concat(F.lit(" STEP "), F.col("k") % 7 + 1).alias("canvas_step_nm"),
        F.when(F.col("k") % 3 == 1, "  ").when(F.col("k") % 3 == 2, "Variant 1").alias("canvas_variation_nm"),
        F.concat(F.lit("C"), F.col("k") % 4).alias("campaign_id"),
    )


def raw_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    bought = _with_faults(table(spark, sf_dir, "events").where("event_type = 'purchase'")).withColumn("k", _k())
    key, day = _faulty(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.to_date("ts").cast("string"))
    return bought.join(places, F.col("user_id") == F.col("c_custkey")).select(
        _wave("ts", "2024-01-16"),
        key.alias("msisdn"),
        day.alias("fecha_conv"),
        F.concat(F.lit("ch"), F.col("k") % 4).alias("channel"),
        F.lower("n_name").alias("ciudad"),
        F.concat(F.col("r_name"), F.lit(" ")).alias("departamento"),
        F.col("c_mktsegment").alias("bfr_vc_nm"),
        F.when(F.col("k") % 5 > 0, F.concat(F.lit("plan "), F.col("k") % 5)).alias("bfr_dt_nm"),
    )


def events_journey(spark: SparkSession, sf_dir: str, config: JourneyConfig = EVENTS) -> Journey:
    return Journey.from_raw(raw_touches(spark, sf_dir), raw_conversions(spark, sf_dir), config)


def raw_order_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _wave("l_shipdate", "1998-07-01"),
        _phone("l_orderkey").alias("msisdn"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("cuenta_id"),
        F.concat(F.to_date("l_shipdate").cast("string"), F.lit(" 00:00:00.000 -0600")).alias("fecha_envio"),
        F.concat(F.col("l_returnflag"), F.lit(" ")).alias("canal"),
        F.concat(F.lit("Stage "), F.col("l_linestatus")).alias("canvas_step_nm"),
        F.concat(F.lit("Line "), F.col("l_linenumber")).alias("canvas_variation_nm"),
        F.lit(None).cast("string").alias("campaign_id"),
    )


def raw_order_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return table(spark, sf_dir, "orders").join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        _wave("o_orderdate", "1998-07-01"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("msisdn"),
        F.to_date("o_orderdate").cast("string").alias("fecha_conv"),
        F.col("o_orderpriority").alias("channel"),
        F.col("n_name").alias("ciudad"),
        F.col("r_name").alias("departamento"),
        F.col("c_mktsegment").alias("bfr_vc_nm"),
        F.col("o_orderstatus").alias("bfr_dt_nm"),
    )


def orders_journey(spark: SparkSession, sf_dir: str, config: JourneyConfig = ORDERS) -> Journey:
    return Journey.from_raw(raw_order_touches(spark, sf_dir), raw_order_conversions(spark, sf_dir), config)


def channel_frame(spark: SparkSession, sf_dir: str, event_type: str, text_dt: bool, mixed: bool) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == event_type).withColumn("k", _k())
    day = F.to_date("ts")
    df = events.select(
        F.lit("gt").alias("instance_tp"),
        F.lit("send").alias("event_tp"),
        day.alias("date_send_dt"),
        (day.cast("string") if text_dt else day).alias("dt"),
        F.concat(F.lit(" Camp-"), F.when(F.col("k") < 30, "A").when(F.col("k") < 60, "b").otherwise("C")).alias("campaign_id"),
        F.col("user_id").cast("string").alias("external_user_id"),
        F.concat(F.lit("s"), F.col("k") % 7).alias("canvas_step_id"),
        F.concat(F.lit("STEP "), F.col("k") % 7 + 1).alias("canvas_step_nm"),
        F.when(F.col("k") % 3 == 2, "Variant 1").alias("canvas_variation_nm"),
        F.col("event_id").cast("string").alias("event_id"),
        F.lit("canvas").alias("campaign_type"),
        "k",
    )
    if mixed:
        kind = F.when(F.col("k") % 3 == 0, "SMS").when(F.col("k") % 3 == 1, "WhatsApp ").otherwise("Bridge")
        df = df.withColumn("step_name", kind)
    return df.drop("k")


def channel_sources(spark: SparkSession, sf_dir: str) -> dict[str, ChannelSource]:
    """One source per event type; ``error`` plays the mixed table that names its channel per row."""
    kinds = {"email": "view", "push": "click", "webhook": "error", "inapp": "signup", "contentcard": "purchase"}
    return {
        channel: ChannelSource(
            channel,
            channel_frame(spark, sf_dir, event_type, text_dt=channel == "email", mixed=channel == "webhook"),
            partition_type="string" if channel == "email" else "date",
            has_step_name=channel == "webhook",
        )
        for channel, event_type in kinds.items()
    }


def campaign_sources(spark: SparkSession, sf_dir: str) -> list[ChannelSource]:
    """The two sources of the campaign extraction: mixed table for SMS and WhatsApp, and push."""
    named = channel_sources(spark, sf_dir)
    mixed = ChannelSource(
        "webhook", named["webhook"].table, has_step_name=True, mixed_channels=("sms", "whatsapp")
    )
    return [mixed, ChannelSource("push", named["push"].table, identity_key="vendor_id")]


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots of the customers; BUILDING only shows up in the last one, MACHINERY not in the first."""
    key = F.col("c_custkey")
    snapshot = F.explode(F.array(*[F.lit(s) for s in SNAPSHOTS]))
    return (
        table(spark, sf_dir, "customer")
        .select(
            snapshot.alias("fct_dt"),
            F.when(F.col("c_nationkey") == 24, "sv").otherwise("gt").alias("cntry_cd"),
            F.when(key % 10 != 0, key.cast("string")).alias("external_id"),
            F.when(key % 5 == 1, (key - 1).cast("string"))
            .when(key % 7 == 0, key.cast("string"))
            .alias("vendor_id"),
            F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("502"), F.right("c_name", F.lit(8)))).alias("msisdn"),
            "c_mktsegment",
        )
        .where((F.col("c_mktsegment") != "BUILDING") | (F.col("fct_dt") == SNAPSHOTS[-1]))
        .where((F.col("c_mktsegment") != "MACHINERY") | (F.col("fct_dt") != SNAPSHOTS[0]))
        .drop("c_mktsegment")
    )


def sales_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.trunc(day, "MM").alias("fct_dt"),
        day.alias("evnt_dt"),
        F.when(F.col("o_orderstatus") == "F", "RENOVACION").otherwise("OTRO").alias("evnt_typ"),
        F.col("o_custkey").cast("string").alias("msisdn_dd"),
        F.col("o_orderkey").cast("string").alias("ar_sscrbr_dd"),
        F.when(F.col("o_totalprice") >= 100000, "MOBILE").otherwise("FIXED").alias("sb_bs_un"),
        F.lit("FIXED").alias("mv_bs_un"),
        F.when(F.col("o_orderpriority") != "5-LOW", "FACTURABLE").otherwise("OTRO").alias("bllbl_cd"),
    )


def campaign_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("campaign_id_key"),
        F.col("p_name").alias("campaign_nm"),
        F.col("p_brand").alias("journey_nm"),
        F.col("p_type").alias("channel_tp"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:00:00")).alias("created_at_ts"),
        F.lit("gt").alias("d_instance_tp"),
    )
