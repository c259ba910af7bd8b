"""Counts that tell a broken input from a poor result, and gates that stop on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import pct, round_half
from touchpath.operators.attribution import ownership_counts
from touchpath.operators.cleaning import RULES, CleaningRules, validity_counts
from touchpath.operators.windows import SUBJECT_KEY


class QualityError(RuntimeError):
    """An input or an attribution that cannot be reported on."""


def _subjects(df: DataFrame, rows: str) -> DataFrame:
    return df.groupBy(*SUBJECT_KEY).agg(F.count("*").alias(rows))


def overlap(touches: DataFrame, conversions: DataFrame) -> DataFrame:
    """Rows and subjects of both facts and the subjects they share, per wave.

    Each fact is reduced to one row per subject, and those rows meet once.
    """
    both = _subjects(touches, "envios").join(_subjects(conversions, "renovaciones"), list(SUBJECT_KEY), "full_outer")
    shared = F.count_if(F.col("envios").isNotNull() & F.col("renovaciones").isNotNull())
    return (
        both.groupBy(K.WAVE)
        .agg(
            F.coalesce(F.sum("envios"), F.lit(0)).alias("filas_envios"),
            F.count("envios").alias("msisdn_envios"),
            F.coalesce(F.sum("renovaciones"), F.lit(0)).alias("filas_renov"),
            F.count("renovaciones").alias("msisdn_renov"),
            shared.alias("msisdn_en_ambos"),
        )
        .withColumn("pct_en_ambos", pct("msisdn_en_ambos", F.greatest("msisdn_renov", F.lit(1)), 1))
    )


def read_and_valid(
    raw_touches: DataFrame, raw_conversions: DataFrame, rules: CleaningRules = RULES
) -> DataFrame:
    """Rows read and valid for both inputs, per wave (conversion records before removing repeats)."""
    touches = validity_counts(raw_touches, K.TOUCH_DATE, rules)
    conversions = validity_counts(raw_conversions, K.CONV_DATE, rules)
    return touches.select(
        K.WAVE, F.col("leidos").alias("envios_leidos"), F.col("validos").alias("envios_validos")
    ).join(
        conversions.select(
            K.WAVE, F.col("leidos").alias("reno_leidas"), F.col("validos").alias("reno_validas")
        ),
        K.WAVE,
        "full_outer",
    )


def quality_report(touches: DataFrame, conversions: DataFrame, owners: DataFrame) -> DataFrame:
    """Reach, overlap, ties, baseline and out-of-window records per wave."""
    return overlap(touches, conversions).join(ownership_counts(owners), K.WAVE, "left").select(
        K.WAVE,
        F.col("msisdn_envios").alias("msisdn_envio"),
        F.col("msisdn_en_ambos").alias("msisdn_con_reno"),
        F.coalesce("atribuciones", F.lit(0)).alias("atribuciones"),
        F.coalesce("empates", F.lit(0)).alias("empates"),
        F.coalesce("sin_atribuir", F.lit(0)).alias("sin_atribuir"),
        F.coalesce("fuera_de_ventana", F.lit(0)).alias("reno_fuera_ventana"),
    )


def ties(attribution: DataFrame) -> DataFrame:
    """Attributions the channel priority decided, per wave."""
    tied = F.count_if(F.col("canales_mismo_dia") > 1)
    return attribution.groupBy(K.WAVE).agg(
        tied.alias("empates"),
        F.count("*").alias("total"),
        round_half(F.lit(100.0) * tied / F.count("*"), 1).alias("pct_empates"),
    )


def _examples(df: DataFrame, n: int = 3) -> list[str]:
    return [row[0] for row in df.select(K.SUBJECT).limit(n).collect()]


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise QualityError(f"no valid {what} left after cleaning: 8-digit subject and readable date needed")


def require_overlap(touches: DataFrame, conversions: DataFrame) -> None:
    """Stop when no subject occurs on both sides, showing keys of each."""
    subjects = conversions.select(*SUBJECT_KEY).distinct()
    if touches.select(*SUBJECT_KEY).distinct().join(subjects, list(SUBJECT_KEY), "left_semi").isEmpty():
        raise QualityError(
            f"no subject of the touches occurs in the conversions; touches look like "
            f"{_examples(touches)}, conversions like {_examples(conversions)}"
        )


def require_attributions(
    attribution: DataFrame, touches: DataFrame, conversions: DataFrame, last_touch_days: int
) -> None:
    """Stop when a wave of the touches has no attribution at all, listing the likely causes."""
    waves = [
        row[0]
        for row in touches.select(K.WAVE).distinct()
        .join(attribution.select(K.WAVE).distinct(), K.WAVE, "left_anti")
        .collect()
    ]
    if waves:
        raise QualityError(
            f"no conversion attributed in {sorted(waves)}; check in this order: subject format "
            f"(touches {_examples(touches)}, conversions {_examples(conversions)}), the report "
            f"interval, and the last-touch limit ({last_touch_days} days)"
        )


def per_wave(waves: Sequence[str], condition: Column | None = None) -> list[Column]:
    """One count for each of ``waves``, to observe while rows pass."""
    return [F.count_if((F.col(K.WAVE) == w) & (F.lit(True) if condition is None else condition)).alias(w) for w in waves]


@dataclass(frozen=True)
class WaveVerdict:
    """What passed while a wave was stored, and what stops its reports, if anything."""

    wave: str
    touches_read: int
    touches_valid: int
    conversions_read: int
    conversions_valid: int
    reached: int | None = None
    attributed: int | None = None

    @property
    def problem(self) -> str | None:
        for what, read, valid in (
            ("touches", self.touches_read, self.touches_valid),
            ("conversions", self.conversions_read, self.conversions_valid),
        ):
            if not valid:
                return f"no valid {what} left of {read} read: 8-digit subject and readable date needed"
        if self.reached == 0:
            return "no subject of the touches occurs in the conversions: compare their formats"
        if self.attributed == 0:
            return "no conversion attributed: check the report interval, then the last-touch limit"
        return None


def verdicts(waves: Sequence[str], observed: dict[str, Observation]) -> list[WaveVerdict]:
    """One verdict per wave from what was ``observed`` under the names of the verdict's fields."""
    counts = {name: seen.get for name, seen in observed.items()}
    return [WaveVerdict(w, **{name: found[w] for name, found in counts.items()}) for w in waves]


def require_passed(found: Sequence[WaveVerdict]) -> None:
    """Stop when any wave has a problem, naming all of them."""
    problems = [f"{v.wave}: {v.problem}" for v in found if v.problem]
    if problems:
        raise QualityError("; ".join(problems))
