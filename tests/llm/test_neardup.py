from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from llm.conftest import documents, words
from touchpath.llm import components as module
from touchpath.llm import neardup
from touchpath.llm.components import components


def shingle_set(text: str | None) -> frozenset:
    tokens = (text or "").encode().lower().split()
    return frozenset(tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))) if tokens else frozenset()


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, set size, smallest id reachable) of every row, by comparing all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)] += [r[0]] if r[0] is not None else []
    return sorted(((r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)), key=repr)


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows_equal_brute_force(spark, odd_rows, clashing):
    got = neardup.near_duplicates(documents(spark, odd_rows, clashing)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(odd_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_of_every_similarity_equal_brute_force(spark):
    """Copies with 0 to 8 % of their words edited: links on both sides of the limit, chains, and a shared passage."""
    rng = random.Random(8)
    rows, passage = [], words(rng, 60, 10**6)
    for base in range(12):
        text = words(rng, rng.randrange(6, 250), 10**6)
        rows += [(1000 * base + i, edited(rng, text, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))) for i in range(12)]
    rows += [(90_000 + i, f"{passage} {words(rng, rng.randrange(5, 40), 10**6)}") for i in range(120)]
    rows = [(d, t.upper() if d % 3 else t) for d, t in rows]
    got = neardup.near_duplicates(documents(spark, rows), neardup.NearDupOptions(block=2000)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("block_sets", [16, 1024])
def test_many_small_sets_with_a_common_shingle(spark, block_sets):
    """Texts that only share a phrase meet in large buckets, stay apart, and links among them are still found."""
    rng = random.Random(4)
    rows = [(i, f"click here to read more x{rng.randrange(900)}") for i in range(1200)]
    rows += [(5000 + i, f"{' '.join(f'p{k}' for k in range(40))} tail{i % 150} end{i}") for i in range(300)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(documents(spark, rows), neardup.NearDupOptions(block_sets=block_sets, most_blocks=2)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_a_full_block_needs_little_memory():
    """The largest block of a bucket: its matrices grow with the sets, which are bounded too."""
    options = neardup.NearDupOptions()
    n = 2 * options.block_sets  # a pair of blocks
    sets = [np.array([1, 10 + i], np.uint64) for i in range(n)]
    numbers = np.arange(n)
    tracemalloc.start()
    assert neardup._forest(numbers, numbers, numbers % 2, sets, True, options.percent) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_clashing_columns_and_ids(spark):
    docs = documents(spark, [(1, "one two three four five six"), (2, "one two three four five six"), (None, "")]).selectExpr("*", "1 AS _id", "2 AS _hash", "3 AS _own_hash", "4 AS component")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "None"]


def test_one_of_each_group_stays(spark, odd_rows):
    docs = documents(spark, odd_rows)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = brute(odd_rows)
    assert sorted(i for i in ids if i is not None) == sorted({c for d, _, c in groups if c is not None and d is not None})
    assert ids.count(None) == 2


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, []).limit(0)).collect() == []


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 3000):
        items = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert (neardup.sketch(items, 384) == neardup.sketch(items[::-1].copy(), 384)).all()
    a = rng.integers(0, 2**63, 600, dtype=np.uint64)
    b = np.concatenate([a[:514], rng.integers(0, 2**63, 86, dtype=np.uint64)])
    assert abs((neardup.sketch(a, 384) == neardup.sketch(b, 384)).mean() - 514 / 686) < 0.08


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    links += [(2000, 2001 + i) for i in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_run_in_few_tasks(spark, monkeypatch):
    """However many partitions a shuffle has; many edges keep them, with the same components."""
    store, parts = module.cut_lineage, []

    def cut(df):
        done = store(df)
        parts.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(module, "cut_lineage", cut)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = []
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for few in (1_000_000, 0):
            monkeypatch.setattr(module, "FEW", few)
            parts.clear()
            found.append({(r.node, r.component) for r in components(links).collect()})
            assert len(parts) > 4 and set(parts[1:]) == {1 if few else 23}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
