from __future__ import annotations

import random

import numpy as np
import pytest
import zstandard

import __spark_entry__ as entry
from llm.conftest import documents, words
from touchpath.llm import quality, toxicity
from touchpath.llm.training import fit_logistic, labelled_sample, sigmoid

LABELS = "doc_id long, label int"
INSULT = ("idiot", "moron", "worthless")


def corpus(seed: int, toxic: bool) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        text, bad = words(rng, rng.randrange(20, 200), 3000), i % 3 == 0
        if bad and toxic:
            tokens = text.split()
            tokens.insert(rng.randrange(len(tokens)), rng.choice(INSULT))
            text = " ".join(tokens)
        elif bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(text.split()[:4] * 20)])
        rows.append((i, text))
        labels.append((i, int(bad) if toxic else int(not bad)))
    return rows, labels


@pytest.mark.parametrize(("module", "scores", "toxic"), [(quality, "quality_scores", False), (toxicity, "toxicity_scores", True)])
def test_held_out_accuracy(spark, module, scores, toxic):
    rows, labels = corpus(1, toxic)
    docs = documents(spark, rows)
    model = module.train(docs, spark.createDataFrame(labels[:280], LABELS))
    got = {r.doc_id: r for r in getattr(module, scores)(docs, model).collect()}
    assert np.mean([got[d].predicted == y for d, y in labels[280:]]) > 0.95
    assert all(r.predicted == (r.score >= model.options.threshold) for r in got.values())


@pytest.mark.parametrize(("module", "scores", "toxic"), [(quality, "quality_scores", False), (toxicity, "toxicity_scores", True)])
def test_odd_rows_and_empty_tables(spark, odd_rows, module, scores, toxic):
    rows, labels = corpus(2, toxic)
    train = documents(spark, [*rows, (rows[0][0], "another text of this id"), (None, "x")])
    odd_labels = [*labels, (None, 1), (3, None), (4, 7), (10**6, 1), labels[0], (labels[1][0], 1 - labels[1][1])]
    model = module.train(train, spark.createDataFrame(odd_labels, LABELS))
    again = module.train(train.repartition(5), spark.createDataFrame(odd_labels, LABELS).repartition(3))
    docs = documents(spark, odd_rows, clashing=True)
    got = getattr(module, scores)(docs, model).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in odd_rows), key=repr)
    assert all(0 <= r.score <= 1 for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, getattr(module, scores)(docs, again).collect()))
    blank = {r.score for r in got if r.doc_id in (100, 101, 102)}
    assert len(blank) == 1 and (toxic or blank == {0.0})
    untrained = module.train(documents(spark, []).limit(0), spark.createDataFrame([], LABELS))
    assert {r.score for r in getattr(module, scores)(documents(spark, [(1, "some text")]), untrained).collect()} == {0.5}
    assert getattr(module, scores)(docs.limit(0), model).collect() == []


def test_one_class_alone(spark):
    rows, labels = corpus(3, False)
    docs = documents(spark, rows)
    for module, scores in ((quality, "quality_scores"), (toxicity, "toxicity_scores")):
        model = module.train(docs, spark.createDataFrame([r for r in labels if r[1] == 1], LABELS))
        assert all(0 <= r.score <= 1 for r in getattr(module, scores)(docs, model).collect())


def test_whole_texts_count(spark):
    """An insult at the end of a very long text is found."""
    rows, labels = corpus(4, True)
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    long = words(random.Random(5), 20_000, 3000)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(documents(spark, [(1, long), (2, long + " idiot")]), model).collect()}
    assert got[2] > got[1]


def test_ratios_equal_counting(spark):
    """Log-count ratios of whole training texts, by sets of byte n-grams."""
    rows, labels = corpus(8, True)
    rows[0] = (0, words(random.Random(1), 20_000, 30_000) + " idiot")
    options = toxicity.ToxicityOptions(lengths=(3, 4), bits=18)
    docs, frame = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    counts = toxicity._counts(labelled_sample(docs, frame, 2000), options)
    grams = {d: {g for n in options.lengths for g in zip(*(f" {t} ".encode()[i:] for i in range(n)), strict=False)} for d, t in rows}
    number = {g: next(iter(toxicity.features(bytes(g), toxicity.ToxicityOptions(lengths=(len(g),), bits=18))))[0] for g in set().union(*grams.values())}
    want = np.zeros_like(counts)
    for d, y in labels:
        want[y, sorted({int(number[g]) for g in grams[d]})] += 1
    want[:, want.sum(axis=0) < options.min_rows] = 0
    assert (counts == want).all()
    n = np.array([sum(y == k for _, y in labels) for k in (0, 1)], float)
    ratio, used = toxicity.log_count_ratios(counts, n, options)
    at = int(number[tuple(b"idio")])
    assert ratio[at] == pytest.approx(np.log((want[1, at] + 1) / (n[1] + 2) / ((want[0, at] + 1) / (n[0] + 2)))) and used[at]


def test_sizes_equal_plain_compression():
    """Compressed sizes of whole texts, piece by piece, by direct calls of zstandard."""
    rng = random.Random(3)
    good, bad = ([words(rng, 150, 300).encode()[:1024] for _ in range(200)] for _ in range(2))
    model = quality.CompressionModel(good, bad)
    for text in (words(rng, 5000, 300), "x", "", "é" * 3000):
        data, want = text.encode(), [len(text.encode())]
        for content in (model.good, model.bad):
            tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            want.append(sum(len(tool.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        plain, *sizes = model.sizes(text)
        assert plain == want[0] and all(abs(a - b) <= 0.01 * b + 8 for a, b in zip(sizes, want[1:], strict=True))


def test_training_reads_whole_texts(spark):
    """What tells the classes apart stands behind the first 100,000 bytes of every training text."""
    rng = random.Random(9)
    rows = [(i, words(rng, 16_000, 200) + (" foul idiot worthless moron" * 4 if i % 2 else " kind words and thanks" * 4)) for i in range(40)]
    docs, frame = documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(40)], LABELS)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, toxicity.train(docs, frame)).collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_filter_keeps_columns(spark, odd_rows):
    rows, labels = corpus(6, False)
    model = quality.train(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    docs = documents(spark, [*rows, *odd_rows], clashing=True)
    kept = quality.keep_good(docs, model)
    assert kept.dtypes == docs.dtypes
    want = quality.quality_scores(docs, model).where("predicted = 1").count()
    assert kept.count() == want


def test_sample_is_bounded_weighted_and_stable(spark):
    rows, labels = corpus(7, True)
    got = labelled_sample(documents(spark, rows), spark.createDataFrame(labels, LABELS), 50)
    got = got.collect()
    assert [sum(r.label == k for r in got) for k in (0, 1)] == [50, 50]
    shares = [sum(r.weight for r in got if r.label == k) for k in (0, 1)]
    texts = dict(rows)
    assert all(r.text == texts[r.doc_id] for r in got)
    assert shares[0] / shares[1] == pytest.approx(sum(y == 0 for _, y in labels) / sum(y for _, y in labels))


def test_logistic_fit_recovers_weights():
    rng = np.random.default_rng(0)
    x = np.stack([np.ones(20_000), rng.normal(size=20_000), rng.normal(size=20_000)], axis=1)
    y = (rng.random(20_000) < sigmoid(x @ np.array([-1.0, 2.0, 0.5]))).astype(float)
    assert fit_logistic(x, y, np.ones(len(y))) == pytest.approx([-1.0, 2.0, 0.5], abs=0.12)


@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.9), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_rows_of_the_given_tables(spark, name, label, least):
    """A few hundred labelled rows to learn from; on the larger tables both are above 0.99."""
    folder = "/root/testdata/sf0.01"
    got = entry.queries()[name](spark, folder).where("held_out")
    both = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", label).collect()
    assert np.mean([a == b for a, b in both]) >= least
