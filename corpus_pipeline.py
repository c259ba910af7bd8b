"""From raw documents to packed training sequences.

Every stage works on all that its predecessor kept. Between stages the rows are written as Parquet in the shared
checkpoint folder, so a lost executor costs the running stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchpath.llm import lines, mixing, neardup, packing, quality
from touchpath.llm.common import table
from touchpath.llm.queries import digests, learnt_quality, sequences
from touchpath.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from ``labels`` and the texts of ``docs``."""
    return quality.keep_good(docs, learnt_quality(spark, docs, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, and documents of which nothing else is left."""
    return lines.drop_later_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat with the epochs of their source."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence."""
    return sequences(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, sketches and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows of the last stage: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``.

    The tables of the stages go when the application ends; write the rows where they are to stay.
    """
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered report: the rows of ``packed_sequences`` with a digest in place of their ids."""
    return digests(packed_sequences(spark, sf_dir))
