"""Subject keys: the digits two systems have in common."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_DIGITS = 8


def subject_key(col: Column | str, digits: int = KEY_DIGITS) -> Column:
    """Last ``digits`` digits of a phone number in any spelling (text, never a number)."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.substring(F.regexp_replace(text, "[^0-9]", ""), -digits, digits)


def suffix_key(col: Column | str, digits: int = KEY_DIGITS) -> Column:
    """Last ``digits`` characters as they are, punctuation included."""
    text = F.col(col) if isinstance(col, str) else col
    return F.substring(text.cast("string"), -digits, digits)
