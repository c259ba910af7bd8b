"""Bounded labelled samples and the logistic fits of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.session import cut_lineage


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """``doc_id``, ``text``, ``label``, ``weight`` of at most ``rows_per_class`` rows of each class, the same in every run, stored.

    The ids are chosen by hash from ``labels`` (``doc_id``, ``label``) alone, and only they meet on the driver; texts are whole
    and stay in the tasks. The weight restores the classes' true shares. Null labels and ids teach nothing; an id labelled
    both ways counts as both; a labelled id without a document is skipped.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    totals = known.groupBy("label").agg(F.count("*").alias("total"))
    chosen = []
    for label in (0, 1):  # a bounded top-k for each class
        ordered = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        chosen += [tuple(r) for r in ordered.collect()]
    picked = docs.sparkSession.createDataFrame(sorted(set(chosen)), "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # One text of an id: an id that a third of all rows share must not fetch them all.
    one = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = cut_lineage(one.join(F.broadcast(picked), "doc_id"))
    taken = rows.groupBy("label").agg(F.count("*").alias("taken"))
    shares = taken.join(totals, "label").select("label", (F.col("total") / F.col("taken")).alias("each"), "total", "taken").collect()
    mean = sum(r["total"] for r in shares) / max(1, sum(r["taken"] for r in shares))
    weight = F.lit(None).cast("double")
    for r in shares:
        weight = F.when(F.col("label") == r["label"], F.lit(r["each"] / mean)).otherwise(weight)
    return rows.withColumn("weight", weight)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; column 0 of ``x`` is the constant and is not penalised."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    centre[0], spread[0] = 0.0, 1.0
    spread[spread == 0] = 1.0
    z = (x - centre) / spread
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-9
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ beta)
        gradient = z.T @ (weight * (y - p)) - ridge @ beta
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    beta = beta / spread
    beta[0] -= (beta * centre).sum()
    return beta
