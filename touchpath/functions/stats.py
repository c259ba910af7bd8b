"""Two-proportion test on aggregated counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _num(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def two_proportion_z(x1: Column | str, n1: Column | str, x2: Column | str, n2: Column | str) -> Column:
    """Pooled z statistic; NULL when a group is empty or the pooled error is zero."""
    x1, n1, x2, n2 = _num(x1), _num(n1), _num(x2), _num(n2)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    error = F.sqrt(
        pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    )
    return F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), error)


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of ``z``; Spark SQL has no ``erfc``."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")
