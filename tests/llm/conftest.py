from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators make themselves.
CLASHING = "score double, size long, target double, length long, start long, piece int, key long, node long, rows long, n long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    """``(doc_id, text[, source])`` rows as documents, with further columns if asked for."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clashing:
        df = df.selectExpr("*", *[f"cast(7 as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")])
    return df


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Null ids and texts, empty and blank texts, a very long text, repeated rows, null and hot sources."""
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 80)), rng.choice(["a", "a", "b", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, " \n\t ", None), (103, words(rng, 30_000), "c"), (None, "no id here at all", "c")]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(104, "x" * 300_000, "d"), (None, None, None)]
    rows += [(200 + i, rows[7][1], "a") for i in range(40)]
    return rows
