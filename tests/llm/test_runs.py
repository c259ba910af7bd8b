from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from llm.conftest import documents
from touchpath.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """All periods of all places, without any index."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(12, 2 * q):
                found.setdefault((start, length), q)
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    exponent = 1000 * best[1] // best[2] if found else None
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, exponent, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def texts() -> list[str]:
    rng = random.Random(13)
    made = ["a " * 11, "a " * 12, "a b " * 6, "a b c " * 4 + "a", "x " + "a a b " * 9 + "y", "a\x1cb c " * 8]
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    made.append(" ".join(fib[-1]))
    for k in range(150):
        alphabet = "abcdefgh"[: rng.randrange(1, 6)]
        words = [rng.choice(alphabet) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            unit = [rng.choice("abcxyz") for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(0, len(words) + 1)
            times = rng.randrange(2, 8)
            words[at:at] = (unit * times)[: len(unit) * times - rng.randrange(0, len(unit))]
        made.append(rng.choice([" ", "\n", " \t"]).join(words))
    return made


def test_runs_equal_brute_force():
    split = [t.split(" ") for t in texts()]
    assert runs.periodic_runs(split) == [brute(t) for t in split]
    assert [runs.periodic_runs([t])[0] for t in split[:40]] == [brute(t) for t in split[:40]]


@pytest.mark.parametrize("clashing", [False, True])
def test_report_equals_brute_force(spark, odd_rows, clashing):
    rows = list(enumerate(texts())) + [r[:2] for r in odd_rows if len((r[1] or "").split()) < 5000]
    got = runs.run_report(documents(spark, rows, clashing), runs.RunOptions(block_words=700), runs.repeat_tail).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((row(*r) for r in rows), key=repr)


def test_find_runs(spark):
    rows = [(1, "a b " * 10), (2, "no run here"), (None, "z " * 30)]
    got = {tuple(r) for r in runs.find_runs(documents(spark, rows)).collect()}
    assert got == {(1, 0, 20, 2), (None, 0, 30, 1)}


def test_long_text():
    """A text of 200,000 words with a long run, by counting."""
    rng = random.Random(2)
    head = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    unit = [f"v{i}" for i in range(999)]
    words = head + unit * 50 + ["end"] + ["z"] * 50_000
    assert runs.periodic_runs([words, ["q"] * 20]) == [[(100_000, 49_950, 999), (149_951, 50_000, 1)], [(0, 20, 1)]]


def test_empty_table(spark):
    assert runs.run_report(documents(spark, []).limit(0)).collect() == []
