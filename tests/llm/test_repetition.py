from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from llm.conftest import documents, words
from touchpath.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(tokens: list[str], n: int) -> list[tuple]:
    return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def brute(text: str | None) -> tuple:
    text = text or ""
    tokens = WORD.findall(text)
    chars = sum(map(len, tokens))

    def covered(n: int) -> set:
        found = windows(tokens, n)
        counts = Counter(found)
        return {i + k for i, w in enumerate(found) if counts[w] > 1 for k in range(n)}

    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                lines, line_chars = lines + 1, line_chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    limits, repeat = repetition.LIMITS, len(covered(8))
    failed = len(tokens) < 20 or 100 * repeat > 30 * len(tokens)
    over = False
    for n, most in limits.top:
        again = [c * sum(map(len, w)) for w, c in Counter(windows(tokens, n)).items() if c > 1]
        over |= bool(again) and max(again) / chars > most
    for n, most in limits.covered:
        over |= bool(chars) and sum(len(tokens[i]) for i in covered(n)) / chars > most
    symbols = sum(c in "#*$%&|<>" for c in text)
    over |= bool(chars) and (line_chars / chars > limits.line_chars or symbols / len(tokens) > limits.symbol_words)
    return len(tokens), chars, symbols, lines, repeat, failed, not (failed or over)


def texts() -> list[str | None]:
    rng = random.Random(6)
    made: list[str | None] = [None, "", " \n\n ", "a", "a " * 500, "é ü   x", "line one\nline one\n\n\nline one", "w\x00 \x1c x"]
    for vocabulary in (2, 5, 20, 100, 1000):
        for n in (7, 8, 9, 25, 60, 300):
            text = words(rng, n, vocabulary)
            made += [text, text + "\n" + text, f"{text}\n{words(rng, n, 10**6)}\n{text}", text.replace(" ", " | ")]
    return made


@pytest.mark.parametrize("clashing", [False, True])
def test_equals_brute_force(spark, odd_rows, clashing):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), *[r[:2] for r in odd_rows]]
    got = repetition.repetition_rules(documents(spark, rows, clashing))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = Counter((r.doc_id, *(r[n] for n in names)) for r in got.collect())
    assert found == Counter((d, *brute(t)) for d, t in rows)


def test_verdicts(spark):
    rng = random.Random(9)
    clean = [words(rng, n, 10**5) for n in (30, 200, 2000, 20_000)]
    line = words(rng, 10, 10**5)
    spam = ["buy now " * 40, "\n".join([line] * 20), " | ".join(clean[1].split()), words(rng, 100, 3)]
    got = {r.doc_id: r.kept for r in repetition.repetition_rules(documents(spark, list(enumerate(clean + spam)))).collect()}
    assert [got[i] for i in range(8)] == [True] * 4 + [False] * 4


def test_empty_table(spark):
    assert repetition.repetition_rules(documents(spark, []).limit(0)).collect() == []
