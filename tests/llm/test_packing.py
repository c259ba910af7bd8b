from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.conftest import documents
from touchpath.llm import packing, queries
from touchpath.llm.prefix import uniform_key


@pytest.fixture(scope="module")
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_special_and_odd_texts(tokenizer):
    for text in ("<|endoftext|>", "a<|endoftext|> b", "don't  stop\n\n  x\t", "é́  ﻿", "1234 \U0001f600", "a" * 5000, " " * 3000):
        assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n", "\u3000", "\x1c "])
def test_ids_of_very_long_blank_runs(tokenizer, blank):
    run = blank * (2_000_000 // len(blank) if blank in " \n\t" else 30_000)
    for text in (run, f"a{run}b", f"a{run}\n{run}<|endoftext|>{run} b"):
        text = text if len(text) < 2_100_000 else text[:2_000_003]
        assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_rows_without_an_id_spread_over_all_slices(spark):
    """200,000 equal rows: no id gathers them."""
    rows = spark.range(200_000).selectExpr("cast(null as long) AS doc_id", "0 AS piece", "1L AS length")
    key = rows.withColumn("key", uniform_key(F.monotonically_increasing_id()))
    slices = key.groupBy((F.col("key") / 2**52).cast("int")).count().collect()
    assert len(slices) == 256 and max(r["count"] for r in slices) < 1100
    packed = packing.pack(rows)
    assert packed.agg(F.countDistinct("sequence_id", "offset"), F.max("sequence_id")).first() == (200_000, -(-200_000 // 2048) - 1)


@pytest.mark.parametrize("clashing", [False, True])
def test_round_trip(spark, odd_rows, tokenizer, clashing):
    got = queries.packed(documents(spark, odd_rows, clashing)).collect()
    wanted = defaultdict(int)
    for doc_id, text, _ in odd_rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        ends = [len(ids)] if len(ids) <= 2048 else list(range(first, len(ids) + 1, 2048))
        for piece, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
            wanted[doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
    for r in got:
        wanted[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
    assert not any(wanted.values())
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_sequences_hold_the_ids(spark, odd_rows, tokenizer):
    rows = [(i, text) for i, (_, text, _) in enumerate(odd_rows)]
    got = queries.sequences(documents(spark, rows)).collect()
    of = defaultdict(dict)
    for r in got:
        assert len(r.ids) == 4 * r.length
        of[r.doc_id][r.start] = bytes(r.ids)
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert b"".join(of[i][start] for start in sorted(of[i])) == ids.tobytes()


def test_fullest_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 12): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 40)
        best = max(s for n in product(*(range(c + 1) for c in counts.values())) if (s := sum(a * b for a, b in zip(n, counts, strict=True))) <= room)
        chosen = packing.fullest(room, counts)
        assert sum(k * v for k, v in chosen.items()) == best and all(v <= counts[k] for k, v in chosen.items())


def test_plan_uses_every_length_once():
    rng = random.Random(5)
    histogram = {n: rng.randrange(1, 10_000_000) for n in rng.sample(range(1, 2049), 300)}
    bins = packing.plan_bins(histogram, 2048)
    used = defaultdict(int)
    for times, bin_ in bins:
        assert sum(k * v for k, v in bin_.items()) <= 2048
        for k, v in bin_.items():
            used[k] += times * v
    assert used == histogram


def test_errors_and_empty_tables(spark):
    assert queries.packed(documents(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError, match="1 to capacity"):
        packing.pack(spark.createDataFrame([(1, 0, 4000)], "doc_id long, piece int, length long"))
