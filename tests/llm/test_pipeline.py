from __future__ import annotations

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from llm.conftest import documents
from llm.test_lines import brute as lines_brute
from llm.test_neardup import brute as groups_brute
from touchpath.llm import mixing, quality, queries


def stored(df, folder):
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def test_every_stage_on_its_own_input(spark, sf_dir, odd_rows, tmp_path):
    """Each stage against brute force (the classifier against its scores) on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(documents(spark, [(d + 10**6 if d is not None else d, t, s) for d, t, s in odd_rows]).select(docs.columns))
    folder = tmp_path / "tables"
    stored(docs, folder / "documents.parquet")
    stored(spark.read.parquet(f"{sf_dir}/labels.parquet"), folder / "labels.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(stored(stage(spark, kept[-1], str(folder)), tmp_path / str(i)))
    for df in kept[1:-1]:
        assert df.dtypes == docs.dtypes

    model = queries.learnt_quality(spark, docs, str(folder))
    want = quality.quality_scores(docs, model).where("predicted = 1")
    assert Counter(r.doc_id for r in kept[1].collect()) == Counter(r.doc_id for r in want.collect())

    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    cut = lines_brute(rows, 2, 5)
    assert Counter((r.doc_id, r.text) for r in kept[2].collect()) == Counter((d, cut[d, t]) for d, t in rows if cut[d, t].split())

    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    ids = [r.doc_id for r in kept[3].collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in groups_brute(rows) if c is not None})

    budget = sum(r.taken for r in mixing.mix(kept[3]).collect())
    assert sum(len(r.text.encode().split()) for r in kept[4].collect()) == budget

    assert Counter(r.doc_id for r in kept[5].where("piece = 0").collect()) == Counter(r.doc_id for r in kept[4].collect())
    assert kept[5].groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_run_over_the_given_tables(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_last_stage_stores_the_ids(spark, sf_dir):
    rows = corpus_pipeline.packed_sequences(spark, sf_dir).select("ids", "length", "sequence_id", "offset").collect()
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)
    held = Counter()
    for r in rows:
        held[r.sequence_id] += r.length
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 2048


def test_empty_documents(spark, tmp_path):
    documents(spark, []).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
