"""Raw text rows to typed, labelled touches and conversions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpath import constants as K
from touchpath.functions import folded, label_or, local_date, plain_date, subject_key, upper_label_or
from touchpath.functions.keys import KEY_DIGITS


def _null_label(col: str, label: str) -> Column:
    return F.coalesce(F.col(col), F.lit(label))


@dataclass(frozen=True)
class CleaningRules:
    """How strict the two inputs are read."""

    parse_date: Callable[[str], Column] = local_date
    label: Callable[[str, str], Column] = label_or
    full_key: bool = True

    def valid_key(self, key: Column) -> Column:
        return F.length(key) == KEY_DIGITS if self.full_key else key != ""


#: Full keys, dates with offsets, blank labels replaced.
RULES = CleaningRules()
#: The first version of the reports: any non-empty key, plain dates, only NULL labels replaced.
FIRST_RULES = CleaningRules(parse_date=plain_date, label=_null_label, full_key=False)


def _waved(raw: DataFrame, wave: str | None) -> DataFrame:
    return raw if wave is None else raw.withColumn(K.WAVE, F.lit(wave))


def _valid(raw: DataFrame, day: str, rules: CleaningRules) -> DataFrame:
    """Valid rows of ``raw`` with key and ``day`` in typed form, its other columns as they are.

    Both are generated, not projected: a filter would be pushed below a projection, and they would be parsed twice a row.
    """
    parsed = F.inline(F.array(F.struct(subject_key(K.SUBJECT).alias(K.SUBJECT), rules.parse_date(day).alias(day))))
    rest = [c for c in raw.columns if c not in (K.SUBJECT, day)]
    return raw.select(*rest, parsed).where(rules.valid_key(F.col(K.SUBJECT)) & F.col(day).isNotNull())


def clean_touches(
    raw: DataFrame, wave: str | None = None, rules: CleaningRules = RULES, extra: Sequence[str] = ()
) -> DataFrame:
    """Typed touches of valid rows; ``wave`` tags a single input, else the column must exist."""
    return _valid(_waved(raw, wave), K.TOUCH_DATE, rules).select(
        K.WAVE,
        K.SUBJECT,
        K.TOUCH_DATE,
        folded(K.CHANNEL).alias(K.CHANNEL),
        rules.label(K.STEP, K.NO_STEP).alias(K.STEP),
        rules.label(K.VARIATION, K.NO_VARIATION).alias(K.VARIATION),
        K.ACCOUNT,
        *extra,
    )


def clean_conversions(
    raw: DataFrame, wave: str | None = None, rules: CleaningRules = RULES, distinct: bool = True
) -> DataFrame:
    """Typed conversions of valid rows, by default one per distinct record."""
    sources = dict(
        zip(K.CONVERSION_ATTRS, ("channel", "ciudad", "departamento", "bfr_vc_nm", "bfr_dt_nm"))
    )
    clean = _valid(_waved(raw, wave), K.CONV_DATE, rules).select(
        K.WAVE, K.SUBJECT, K.CONV_DATE, *[upper_label_or(src, K.NO_DATA).alias(name) for name, src in sources.items()]
    )
    return clean.distinct() if distinct else clean


def validity_counts(raw: DataFrame, date_column: str, rules: CleaningRules = RULES) -> DataFrame:
    """Rows read and rows kept per wave, one pass."""
    key = subject_key(K.SUBJECT)
    valid = rules.valid_key(key) & rules.parse_date(date_column).isNotNull()
    return raw.groupBy(K.WAVE).agg(
        F.count("*").alias("leidos"), F.count_if(valid).alias("validos")
    )


def between(df: DataFrame, column: str, since: object, until: object) -> DataFrame:
    """Half-open interval on a date column."""
    return df.where((F.col(column) >= F.lit(since)) & (F.col(column) < F.lit(until)))
