from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from touchpath.llm import search

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], k: int = 20) -> list[tuple]:
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 20 == 0:
            asked[i] = min(v, asked.get(i, v))
    found = []
    for q, u in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for i, v in whole if i != q)
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(found)


def run(spark, rows, options) -> list[tuple]:
    vectors = search.whole_vectors(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as score", "2 as rank", "3 as shard"))
    return sorted(map(tuple, search.top_k(vectors, vectors.where("vec_id % 20 = 0"), options).collect()))


def rows_of(seed: int, n: int, dims: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    made = centres[rng.integers(0, 5, n)] * rng.choice([0, 1, 1], (n, 1)) + 0.4 * rng.normal(size=(n, dims))
    return [(i, (v / 4).tolist(), i % 7) for i, v in enumerate(made)]


@pytest.mark.parametrize("options", [search.OPTIONS, search.SearchOptions(shard_rows=90, query_rows=7, first_rows=25, probe_terms=2), search.SearchOptions(k=3, shard_rows=50, first_rows=1)])
def test_equals_brute_force(spark, options):
    rows = rows_of(1, 500, 24)
    rows += [(500 + i, rows[0][1], 0) for i in range(60)]  # ties
    rows += [(700, None, 1), (None, rows[1][1], 1), (720, [None, *rows[1][1][1:]], 1), (740, [float("nan"), *rows[1][1][1:]], 1), (760, [float("inf"), *rows[1][1][1:]], 1)]
    rows += [(780, rows[2][1][:10], 1), (800, [], 1), (820, [0.0] * 24, 1)]
    assert run(spark, rows, options) == brute(rows, options.k)


def test_the_first_shard_sets_a_floor_for_the_others(spark):
    """Two shards: the second returns only what reaches the first one's k-th score, and nothing is lost."""
    rows = rows_of(9, 400, 12)
    options = search.SearchOptions(k=5, shard_rows=200, query_rows=50, first_rows=10)
    assert run(spark, rows, options) == brute(rows, 5)
    rng = np.random.default_rng(4)
    matrix = rng.integers(-40, 40, (600, 16)).astype(float)
    shard = search.Shard(np.arange(1000, 1600), matrix, search.SearchOptions(k=5, first_rows=50))
    for _ in range(20):
        query = rng.integers(-40, 40, 16).astype(float)
        full = np.sort(matrix @ query)[::-1]
        for floor, want in ((int(full[0]) + 1, 0), (int(full[2]), 3), (int(full[100]), 5), (None, 5)):
            ids, scores = shard.top(0, query, floor)
            assert scores.tolist() == full[:want].tolist() and len(ids) == want


def test_few_repeated_and_no_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (20, [0.5, -1.0], 0), (7, [-3.0, 0.25], 0), (0, [0.25, 0.0], 0), (7, [-3.0, 0.25], 0)]
    assert run(spark, rows, search.OPTIONS) == brute(rows)
    assert run(spark, [(1, [1.0], 0)], search.OPTIONS) == []
    assert run(spark, [(0, [1.0], 0)], search.OPTIONS) == []
    empty = search.whole_vectors(spark.createDataFrame([], VECTORS))
    assert search.top_k(empty, empty).collect() == []


def test_large_values_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 2**24 for _ in range(6)], 0) for i in range(120)]
    assert run(spark, rows, search.SearchOptions(shard_rows=40, first_rows=21)) == brute(rows)


def test_equals_duckdb(spark):
    rows = rows_of(5, 300, 16) + [(300, None, 0), (320, [float("nan")] * 16, 0), (340, [None] * 16, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({search.ORACLE_SQL})").fetchall()
    assert run(spark, rows, search.OPTIONS) == sorted(want)


def test_bounds_prune_without_losing(spark):
    """The shard returns the same as a full product, and leaves candidates out on the way."""
    rng = np.random.default_rng(2)
    matrix = rng.integers(-40, 40, (3000, 32))
    matrix[:60] *= 3
    shard = search.Shard(np.arange(3000), matrix.astype(float), search.SearchOptions(first_rows=200))
    for q in range(30):
        query = (matrix[q] * (rng.random(32) < 0.5)).astype(float)
        ids, scores = shard.top(q, query)
        full = matrix @ query
        order = [i for i in np.lexsort((np.arange(3000), -full)) if i != q][:20]
        assert ids.tolist() == order and scores.tolist() == full[order].tolist()
    kept, _ = shard._competitive(matrix[0].astype(float), float(np.sort(matrix @ matrix[0])[-20]), 200)
    assert len(kept) < 300
