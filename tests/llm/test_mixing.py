from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from llm.conftest import documents
from touchpath.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes: dict, weights=(5, 2, 1), share=1.5) -> dict:
    """Targets by resharing the excess until none is above."""
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes if sizes[s]}
    while open_ and left > 1e-9:
        total, given = sum(weight[s] for s in open_), left
        for s in list(open_):
            more = min(given * weight[s] / total, 2 * sizes[s] - target[s])
            target[s], left = target[s] + more, left - more
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
    return target


@pytest.mark.parametrize("clashing", [False, True])
def test_targets_budgets_and_limits(spark, odd_rows, clashing):
    got = mixing.mix(documents(spark, odd_rows, clashing)).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, s in odd_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(taken[s] == int(next(r.target for r in got if r.source == s)) for s in sizes)


def test_reruns_and_partitions_agree(spark, odd_rows):
    docs = documents(spark, odd_rows)
    first = sorted(map(repr, mixing.mix(docs).collect()))
    assert first == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


def test_equals_duckdb(spark, odd_rows):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(odd_rows)]
    docs = documents(spark, rows)
    con = duckdb.connect()
    con.register("frame", docs.toPandas().astype(object).where(lambda x: x.notna(), None))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in mixing.mix(docs).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_documents_repeat_and_end_inside_the_budget(spark, odd_rows):
    docs = documents(spark, odd_rows)
    budget = {r.source: r.taken for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    originals = {(d, s): t for d, t, s in odd_rows}
    given = defaultdict(int)
    for r in mixed.collect():
        given[r.source] += len(WORD.findall(r.text))
        assert (originals[r.doc_id, r.source] or "").startswith(r.text) and r.n_chars == len(r.text)
    assert all(given[s] == budget[s] for s in budget)


def test_equal_rows_are_taken_one_after_the_other(spark):
    """The budget ends among 107 equal rows: most come whole, one is cut, the others not at all in that pass."""
    rows = [(7, f"t{i} " + "x " * 9, "a") for i in range(107)] + [(i, "y " * 5, "b") for i in range(100, 190)] + [(None, "z " * 4, "b")] * 60
    docs = documents(spark, rows, clashing=True).selectExpr("*", "1 AS _id", "2 AS _mix_id", "3 AS _unnamed", "4 AS _size", "5 AS _take", "6 AS _before_this")
    budget = {r.source: r.taken for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    lengths = [(r.source, len(WORD.findall(r.text))) for r in got.collect()]
    for source, full in (("a", {10}), ("b", {5, 4})):
        mine = [n for s, n in lengths if s == source]
        assert sum(mine) == budget[source] and sum(n not in full for n in mine) <= 1


def test_a_third_of_all_rows_in_one_source_and_empty_tables(spark):
    docs = documents(spark, [(i, "one two three", "hot") for i in range(2000)] + [(i, "x y", f"s{i % 9}") for i in range(3000)])
    totals = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r.taken == int(r.target) for r in totals)
    assert mixing.mix(documents(spark, []).limit(0)).collect() == []
    assert mixing.mix_documents(documents(spark, [(1, None)])).collect() == []
