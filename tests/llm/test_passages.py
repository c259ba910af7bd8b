from __future__ import annotations

import random
from collections import defaultdict

import pytest

from llm.conftest import documents, words
from touchpath.llm import passages


def repeated(rows: list[tuple], n: int) -> dict[int, set]:
    """Word places of every row inside a window of ``n`` words that occurs elsewhere."""
    seen = defaultdict(list)
    for i, r in enumerate(rows):
        tokens = (r[1] or "").encode().split()
        for at in range(len(tokens) - n + 1):
            seen[tuple(tokens[at : at + n])].append((i, at))
    covered = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                covered[rows[i][0]].update(range(at, at + n))
    return covered


def check(spark, rows, options):
    got = passages.repeated_passages(documents(spark, rows, clashing=True), options).collect()
    found = defaultdict(set)
    for r in got:
        assert r.n_words >= options.min_words and r.copies > 1
        found[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert found == repeated(rows, options.min_words)
    return got


@pytest.mark.parametrize("seed", [3, 8, 21])
def test_all_and_only_repeats_are_covered(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.randrange(12, 60), 300).split() for _ in range(12)]
    rows = []
    for d in range(150):
        text: list[str] = []
        for _ in range(rng.randrange(0, 5)):
            part = rng.choice(pool)
            at = rng.randrange(len(part))
            text += words(rng, rng.randrange(0, 30), 300).split() + part[at : at + rng.randrange(1, 60)]
        rows.append((d, " ".join(text)))
    check(spark, rows, passages.PassageOptions(min_words=16, window=6, gram=3))


def test_passages_of_over_fifty_words(spark, odd_rows):
    rng = random.Random(12)
    shared = words(rng, 51, 10**6)
    rows = [(i, f"{words(rng, rng.randrange(0, 300), 10**6)} {shared} {words(rng, rng.randrange(0, 300), 10**6)}") for i in range(300, 330)]
    rows += [(400 + i, words(rng, 500, 10**6)) for i in range(30)]
    rows += [r[:2] for r in odd_rows if r[0] is not None]
    got = check(spark, rows, passages.OPTIONS)
    assert {r.doc_id for r in got if 300 <= r.doc_id < 500} == set(range(300, 330))
    firsts = {r.doc_id: (r.first_doc_id, r.is_first) for r in got if 300 <= r.doc_id < 330}
    assert firsts == {i: (300, i == 300) for i in range(300, 330)}


def test_partners_that_share_too_little_each(spark):
    """A shares 48 words with B and with C, on other sides of a common middle: no passage of 50 words stands twice."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        x, middle, y = (words(rng, n, 10**6) for n in (10, 38, 10))
        pad = [words(rng, 70, 10**6) for _ in range(6)]
        rows += [(3 * i, f"{pad[0]} {x} {middle} {y} {pad[1]}"), (3 * i + 1, f"{pad[2]} {x} {middle} {pad[3]}"), (3 * i + 2, f"{pad[4]} {middle} {y} {pad[5]}")]
    assert check(spark, rows, passages.OPTIONS) == []


def test_copies_with_edits(spark):
    """Many near copies: every key has members that repeat as a whole and members that do not."""
    rng = random.Random(7)
    text = words(rng, 400, 10**6).split()
    rows = [(i, " ".join(w if rng.random() > 0.015 else f"e{rng.randrange(10**6)}" for w in text)) for i in range(120)]
    rows += [(500 + i, " ".join(text)) for i in range(30)] + [(900, " ".join(text + text))]
    check(spark, rows, passages.OPTIONS)


def test_null_ids_and_empty_tables(spark):
    text = words(random.Random(1), 80, 10**6)
    got = passages.repeated_passages(documents(spark, [(None, text), (7, text), (None, None)])).collect()
    assert sorted(((r.doc_id, r.first_doc_id, r.is_first, r.n_words) for r in got), key=repr) == [(7, 7, True, 80), (None, 7, False, 80)]
    assert passages.repeated_passages(documents(spark, []).limit(0)).collect() == []
