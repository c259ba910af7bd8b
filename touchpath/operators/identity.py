"""Account identifiers to subject keys through profile snapshots.

All key columns of a snapshot are melted into one dictionary (one scan, one
shuffle), so a lookup by several keys is one join. Everything that only needs
distinct accounts is reduced to them first; operators that keep every row split
an account that owns a large share of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import match_source, round_half
from touchpath.operators.skew import lookup_join

USER = "external_user_id"


def key_dictionary(profile: DataFrame, key: str, subject: str = K.SUBJECT) -> DataFrame:
    """One subject per value of one key (the smallest; the pair is stable across snapshots)."""
    return profile.groupBy(key).agg(F.min(subject).alias(K.SUBJECT))


def identity_dictionary(profile: DataFrame, keys: Sequence[str], subject: str = K.SUBJECT) -> DataFrame:
    """``user_key`` with one ``msisdn_por_<key>`` column per key, one row per key value."""
    entries = F.array(
        *[
            F.struct(
                F.col(key).alias("user_key"),
                *[
                    (F.col(subject) if other == key else F.lit(None).cast("string")).alias(other)
                    for other in keys
                ],
            )
            for key in keys
        ]
    )
    melted = profile.select(F.inline(entries)).where("user_key is not null")
    return melted.groupBy("user_key").agg(*[F.min(key).alias(f"msisdn_por_{key}") for key in keys])


def stacked_dictionaries(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The per-key dictionaries one below the other, other keys padded with NULL."""
    parts = [
        key_dictionary(profile, key).select(
            F.col(key).alias("user_key"),
            *[(F.col(key) if k == key else F.lit(None).cast("string")).alias(k) for k in keys],
            K.SUBJECT,
        )
        for key in keys
    ]
    return reduce(DataFrame.unionByName, parts)


def resolve(
    events: DataFrame, dictionary: DataFrame, order: Sequence[str], how: str = "left", user: str = USER
) -> DataFrame:
    """Events with ``msisdn`` from the first key in ``order`` that knows the account.

    ``how="left"`` keeps unmatched rows with NULL, ``"inner"`` drops them.
    """
    subject = F.coalesce(*[F.col(f"msisdn_por_{key}") for key in order])
    lookup = dictionary.select(F.col("user_key").alias(user), subject.alias(K.SUBJECT)).where(
        F.col(K.SUBJECT).isNotNull()
    )
    return lookup_join(events, lookup, [user], how)


def resolve_touches(
    touches: DataFrame, dictionary: DataFrame, order: Sequence[str], user: str = USER
) -> DataFrame:
    """Distinct resolved touches. Re-sends collapse *before* the join, hot accounts with them."""
    subject = F.coalesce(*[F.col(f"msisdn_por_{key}") for key in order]).alias(K.SUBJECT)
    lookup = dictionary.select(F.col("user_key").alias(user), subject).dropna()
    return (
        touches.distinct()
        .join(lookup, user)
        .withColumnRenamed(user, K.ACCOUNT)
        .select(K.SUBJECT, K.ACCOUNT, K.TOUCH_DATE, K.CHANNEL, K.STEP, K.VARIATION, K.CAMPAIGN)
    )


def resolve_by_channel(
    touches: DataFrame, dictionary: DataFrame, key_of_channel: Mapping[str, str], default_key: str,
    user: str = USER,
) -> DataFrame:
    """Touches resolved by the one key their channel's accounts belong to (no fall-back)."""
    subject = _subject_of_channel(key_of_channel, default_key)
    return (
        lookup_join(touches, dictionary.withColumnRenamed("user_key", user), [user])
        .withColumn(K.SUBJECT, subject)
        .where(F.col(K.SUBJECT).isNotNull())
        .withColumnRenamed(user, K.ACCOUNT)
        .select(K.SUBJECT, K.ACCOUNT, K.TOUCH_DATE, K.CHANNEL, K.STEP, K.VARIATION, K.CAMPAIGN)
    )


def _subject_of_channel(key_of_channel: Mapping[str, str], default_key: str):
    subject = F.col(f"msisdn_por_{default_key}")
    for channel, key in key_of_channel.items():
        subject = F.when(F.col(K.CHANNEL) == channel, F.col(f"msisdn_por_{key}")).otherwise(subject)
    return subject


def channel_ids(touches: DataFrame, user: str = USER) -> DataFrame:
    """Distinct accounts per channel: the population of every match-rate question."""
    return touches.select(K.CHANNEL, user).distinct()


def all_ids(touches: DataFrame, user: str = USER) -> DataFrame:
    """Distinct accounts over all channels."""
    return touches.select(user).distinct()


def attach_keys(ids: DataFrame, dictionary: DataFrame, user: str = USER, how: str = "left") -> DataFrame:
    return ids.join(dictionary.withColumnRenamed("user_key", user), user, how)


def match_rate(ids: DataFrame, dictionary: DataFrame, key_of_channel: Mapping[str, str], default_key: str) -> DataFrame:
    """Per channel: accounts, with and without subject, percent matched."""
    found = F.col("msisdn").isNotNull()
    return (
        attach_keys(ids, dictionary)
        .withColumn("msisdn", _subject_of_channel(key_of_channel, default_key))
        .groupBy(K.CHANNEL)
        .agg(
            F.count("*").alias("total_ids"),
            F.count_if(found).alias("con_msisdn"),
            F.count_if(~found).alias("sin_msisdn"),
            round_half(F.lit(100.0) * F.count_if(found) / F.count("*"), 1).alias("pct_match"),
        )
    )


def match_by_key(ids: DataFrame, dictionary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per channel: accounts each key finds and accounts no key finds."""
    hits = {key: F.col(f"msisdn_por_{key}").isNotNull() for key in keys}
    nobody = reduce(lambda a, b: a & b, [~hit for hit in hits.values()])
    return (
        attach_keys(ids, dictionary)
        .groupBy(K.CHANNEL)
        .agg(
            F.count("*").alias("total_ids"),
            *[F.count_if(hit).alias(f"match_por_{key}") for key, hit in hits.items()],
            F.count_if(nobody).alias("sin_ningun_match"),
        )
    )


def match_conflicts(ids: DataFrame, dictionary: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """One row: accounts, found by both keys, found by both with different subjects."""
    first, second = (F.col(f"msisdn_por_{key}") for key in keys)
    both = first.isNotNull() & second.isNotNull()
    return attach_keys(ids, dictionary).agg(
        F.count("*").alias("total"),
        F.count_if(both).alias("matchea_ambas"),
        F.count_if(both & (first != second)).alias("matchea_ambas_con_msisdn_distinto"),
    )


def match_listing(
    ids: DataFrame, dictionary: DataFrame, keys: tuple[str, str], only_both: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Account by account: what each key finds and which of them did."""
    columns = [f"msisdn_por_{key}" for key in keys]
    rows = attach_keys(ids, dictionary).select(
        USER, *columns, match_source(*columns, names=keys).alias("fuente_match")
    )
    if only_both:
        rows = rows.where(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull()).drop(
            "fuente_match"
        )
    return rows if limit is None else rows.limit(limit)


def key_coverage(ids: DataFrame, profile: DataFrame, key: str, subject: str = K.SUBJECT) -> DataFrame:
    """One row: accounts, accounts known under ``key`` and accounts with a subject.

    Profiles without a subject count as known; one row per key value, so a
    profile listed twice does not inflate the counts.
    """
    known = profile.groupBy(F.col(key).alias(USER)).agg(
        F.min(subject).alias(K.SUBJECT), F.lit(True).alias("conocido")
    )
    return ids.join(known, USER, "left").agg(
        F.count("*").alias("total_ids"),
        F.count_if(F.col("conocido")).alias(f"match_por_{key}"),
        F.count_if(F.col(K.SUBJECT).isNotNull()).alias("con_msisdn"),
    )


def sample_per_channel(ids: DataFrame, dictionary: DataFrame, key: str, size: int = K.SAMPLE_SIZE) -> DataFrame:
    """Up to ``size`` accounts per channel, matched ones first, kept as (account, subject) pairs.

    The rank filter is applied on every map task before the shuffle, so a task
    sees at most ``size`` rows per channel and input partition.
    """
    return (
        _ranked_ids(ids, dictionary, key)
        .where(F.col("rn") <= size)
        .groupBy(K.CHANNEL)
        .agg(F.sort_array(F.collect_list(F.struct("rn", USER, K.SUBJECT))).alias("filas"))
        .select(
            K.CHANNEL,
            F.col(f"filas.{USER}").alias("external_user_ids"),
            F.col(f"filas.{K.SUBJECT}").alias("msisdns"),
        )
    )


def match_rate_with_sample(
    ids: DataFrame, dictionary: DataFrame, key: str, size: int = K.SAMPLE_SIZE
) -> DataFrame:
    """Match counts per channel next to a sample of its accounts."""
    rate = match_rate(ids, dictionary, {}, key).drop("pct_match")
    sample = sample_per_channel(ids, dictionary, key, size).select(
        K.CHANNEL,
        F.col("external_user_ids").alias("ejemplo_external_user_ids"),
        F.col("msisdns").alias("ejemplo_msisdns"),
    )
    return rate.join(sample, K.CHANNEL, "left")


def _ranked_ids(ids: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    matched = attach_keys(ids, dictionary).withColumn(K.SUBJECT, F.col(f"msisdn_por_{key}"))
    order = Window.partitionBy(K.CHANNEL).orderBy(F.col(K.SUBJECT).asc_nulls_last(), F.col(USER))
    return matched.select(K.CHANNEL, USER, K.SUBJECT, F.row_number().over(order).alias("rn"))


def rows_per_channel(touches: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Touches per channel whose account the key resolves: counted per account before the join."""
    per_account = touches.groupBy(K.CHANNEL, USER).agg(F.count("*").alias("filas"))
    return (
        attach_keys(per_account, dictionary, how="inner")
        .where(F.col(f"msisdn_por_{key}").isNotNull())
        .groupBy(K.CHANNEL)
        .agg(F.sum("filas").alias("filas"))
    )


def measure_before_export(touches: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Rows, accounts, subjects and date range of the resolved touches, without exporting them."""
    per_account = touches.groupBy(USER).agg(
        F.count("*").alias("filas"), F.min(K.TOUCH_DATE).alias("desde"), F.max(K.TOUCH_DATE).alias("hasta")
    )
    return (
        attach_keys(per_account, dictionary, how="inner")
        .where(F.col(f"msisdn_por_{key}").isNotNull())
        .agg(
            F.coalesce(F.sum("filas"), F.lit(0)).alias("envios_con_msisdn"),
            F.count("*").alias("usuarios"),
            F.countDistinct(f"msisdn_por_{key}").alias("telefonos"),
            F.min("desde").alias("desde"),
            F.max("hasta").alias("hasta"),
        )
    )


def shared_subjects(ids: DataFrame, profile: DataFrame, key: str, subject: str = K.SUBJECT) -> DataFrame:
    """Subjects reached through several accounts."""
    pairs = profile.select(F.col(key).alias(USER), F.col(subject).alias(K.SUBJECT)).dropna().distinct()
    return (
        pairs.join(ids.select(USER).distinct(), USER, "left_semi")
        .groupBy(K.SUBJECT)
        .agg(F.count("*").alias("external_ids_con_envio"))
        .where(F.col("external_ids_con_envio") > 1)
    )


def unstable_keys(profile: DataFrame, key: str, subject: str = K.SUBJECT) -> DataFrame:
    """Key values whose subject changes between snapshots."""
    return (
        profile.dropna(subset=[key, subject])
        .groupBy(key)
        .agg(F.countDistinct(subject).alias("msisdn_distintos"))
        .where(F.col("msisdn_distintos") > 1)
    )


def repeated_keys(profile: DataFrame, key: str) -> DataFrame:
    """Key values that occur several times in one snapshot."""
    return (
        profile.dropna(subset=[key])
        .groupBy("fct_dt", key)
        .agg(F.count("*").alias("filas"))
        .where(F.col("filas") > 1)
    )


def suffix_matches(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Distinct left subjects whose key also occurs on the right; both sides reduced first."""
    probe = left.select(K.SUBJECT).distinct().withColumn("llave", key(K.SUBJECT))
    known = right.select(key(K.SUBJECT).alias("llave")).distinct()
    return probe.join(known, "llave", "left_semi").select(K.SUBJECT)
