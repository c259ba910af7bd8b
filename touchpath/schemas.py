"""Declared schemas of the logical tables and a fail-fast check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from touchpath import constants as K


def text_schema(columns: Iterable[str]) -> T.StructType:
    """All-text schema: phone numbers and offset dates must never be inferred."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


RAW_TOUCH_COLUMNS = (
    K.SUBJECT, K.ACCOUNT, K.TOUCH_DATE, K.CHANNEL, K.STEP, K.VARIATION, K.CAMPAIGN,
)
RAW_CONVERSION_COLUMNS = (
    K.SUBJECT, K.CONV_DATE, "channel", "ciudad", "departamento", "bfr_vc_nm", "bfr_dt_nm",
)

#: Columns of one channel table after conforming (webhook tables alone fill ``step_name``).
CHANNEL_COLUMNS = (
    "canal", "instance_tp", "event_tp", "date_send_dt", "dt", "campaign_id", "external_user_id",
    "canvas_step_id", "canvas_step_nm", "canvas_variation_nm", "event_id", "campaign_type",
    "step_name",
)
#: Row-level export: the resolved subject in front, the account renamed.
EXPORT_COLUMNS = (
    "msisdn", "cuenta_id", "canal", "instance_tp", "event_tp", "date_send_dt", "dt", "campaign_id",
    "canvas_step_id", "canvas_step_nm", "canvas_variation_nm", "event_id", "campaign_type",
    "step_name",
)

_S, _D, _I, _L = T.StringType(), T.DateType(), T.IntegerType(), T.LongType()
_TYPES = {
    K.TOUCH_DATE: _D, K.CONV_DATE: _D, "fin_ventana": _D, "primera_fecha": _D,
    "dias_al_convertir": _I, "canales_mismo_dia": _L, "toques_previos": _L,
}


def typed_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES.get(name, _S)) for name in columns])


TOUCHES = typed_schema((K.WAVE, K.SUBJECT, K.TOUCH_DATE, *K.TOUCH_ATTRS))
CONVERSIONS = typed_schema((K.WAVE, K.SUBJECT, K.CONV_DATE, *K.CONVERSION_ATTRS))
WINDOWS = typed_schema((K.WAVE, K.SUBJECT, K.TOUCH_DATE, "fin_ventana"))
ATTRIBUTION = typed_schema(
    (
        K.WAVE, K.SUBJECT, K.CONV_DATE, *K.CONVERSION_ATTRS, K.ACCOUNT, K.TOUCH_DATE, K.CHANNEL,
        K.STEP, K.VARIATION, "dias_al_convertir", "canales_mismo_dia", "toques_previos",
    )
)


def require(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Raise when ``df`` lacks a column of ``schema`` or holds another type; extra columns pass."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, got "
        + (have[f.name].simpleString() if f.name in have else "nothing")
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{table}: " + "; ".join(wrong))
    return df
