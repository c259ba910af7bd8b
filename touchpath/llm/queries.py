"""Registered queries of the operators, over whole tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchpath.llm import conversations, lines, lmscore, mixing, neardup, packing, passages, quality, repetition, runs, search, toxicity, urls
from touchpath.llm.common import crc32_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLE["op1_mixing"] = mixing.ORACLE_SQL


def sequences(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with their ids and their places."""
    return packing.pack(packing.token_pieces(docs, narrow=True)).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def digests(pieces: DataFrame) -> DataFrame:
    """Packed ``pieces`` with a digest in place of their ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs``, packed with their ids, with a digest of the ids and their places."""
    return digests(sequences(docs))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


ORACLE["op4_urls"] = urls.oracle_sql()


@query
def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


ORACLE["op6_lines"] = lines.ORACLE_SQL


@query
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def _quality_held_out() -> Column:
    return crc32_of(F.col("doc_id")) % 4 == 2


def learnt_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.CompressionModel:
    """Trained on the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs, labels.where(~_quality_held_out()))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.quality_scores(docs, learnt_quality(spark, docs, sf_dir))
    return scores.select("doc_id", _quality_held_out().alias("held_out"), "score", "predicted")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of(F.col("doc_id")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE["op10_search"] = search.ORACLE_SQL


@query
def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_of(F.col("doc_id")) % 7 == 2
    scores = lmscore.language_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(table(spark, sf_dir, "conversations")))


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"), change=runs.repeat_tail)
