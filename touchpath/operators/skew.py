"""Row-level joins against one row per key, when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same_value(lookup: DataFrame, key: str) -> Column:
    """``key`` as an expression the planner does not know to be partitioned already."""
    kind = lookup.schema[key].dataType.simpleString()
    if kind == "string":
        return F.concat(F.col(key), F.lit(""))
    if kind == "date":
        return F.date_add(F.col(key), F.lit(0))
    return F.concat(F.col(key).cast("string"), F.lit("")).cast(kind)


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``facts`` joined to a ``lookup`` that holds each key once (inner, left, left_semi, left_anti).

    AQE splits the partition of a heavy key over several tasks, whatever its size, if both sides of the join come
    straight out of a shuffle. A lookup that was just aggregated by the key does not: its partitioning would be taken
    over and a heavy key left to one task. So the join is on the value of the keys, which gives the lookup a shuffle
    of its own. It is the small side; ``facts`` are read once and shuffled once. Rows without a key match nothing.
    """
    renamed = {k: f"_{k}" for k in keys}
    right = lookup.withColumns({own: _same_value(lookup, k) for k, own in renamed.items()}).drop(*keys)
    same = [F.col(k) == F.col(own) for k, own in renamed.items()]
    return facts.join(right, same, how).drop(*renamed.values())
