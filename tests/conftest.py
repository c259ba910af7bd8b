from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Sequence
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from touchpath import schemas  # noqa: E402
from touchpath.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    session = local_session(4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not TESTDATA.exists():
        pytest.skip("given tables not found")
    return str(TESTDATA)


def day(n: int) -> dt.date:
    """Day ``n`` of a fixed calendar."""
    return dt.date(2026, 6, 1) + dt.timedelta(days=n)


def touches(spark: SparkSession, rows: Sequence[tuple], wave: str = "w") -> DataFrame:
    """``(subject, day, channel[, step[, variation[, account]]])`` rows as clean touches."""
    full = []
    for subject, n, channel, *rest in rows:
        step, variation, account = (list(rest) + ["s1", "v", "a"][len(rest):])[:3]
        full.append((wave, subject, day(n), channel, step, variation, account))
    return spark.createDataFrame(full, schemas.TOUCHES)


def conversions(spark: SparkSession, rows: Sequence[tuple], wave: str = "w") -> DataFrame:
    """``(subject, day[, city])`` rows as clean conversions."""
    full = [(wave, r[0], day(r[1]), "store", r[2] if len(r) > 2 else "C", "D", "P", "Q") for r in rows]
    return spark.createDataFrame(full, schemas.CONVERSIONS)


def records(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).collect())


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
