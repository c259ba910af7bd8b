"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpath.session import cut_lineage

#: A word is a run of anything but the six ASCII white-space characters.
#: ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text per Arrow batch. Texts differ in length by a factor of ten thousand, so a batch of the
#: default 10,000 rows could fill a Python worker, and one of 500 long texts still strain it and the JVM's buffers.
TEXT_BATCH_ROWS = 500
TEXT_BATCH_BYTES = 4 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, in a session whose Arrow batches are small enough for long texts."""
    df.sparkSession.conf.set(_BATCH_ROWS, str(TEXT_BATCH_ROWS))
    df.sparkSession.conf.set(_BATCH_BYTES, str(TEXT_BATCH_BYTES))
    return df


def stored_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """``df`` stored now, with at most ``rows`` rows per Arrow batch; the session's own setting comes back."""
    before = df.sparkSession.conf.get(_BATCH_ROWS)
    df.sparkSession.conf.set(_BATCH_ROWS, str(rows))
    try:
        return cut_lineage(df)
    finally:
        df.sparkSession.conf.set(_BATCH_ROWS, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has a column of that name."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def n_words(text: Column) -> Column:
    """Words of ``text`` as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of(column: Column) -> Column:
    """CRC-32 of the value as text; null as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))
