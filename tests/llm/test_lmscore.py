from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import documents, words
from touchpath.llm import attention, lmscore
from touchpath.llm.common import crc32_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = attention.AttentionOptions(groups=4, members=4, single=12, width=6, hidden=8, context=4, stride=6, scored_windows=3)


def tokens(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), ""]


def base(rows: list[tuple], held_out) -> dict:
    counts = Counter(w for d, t in rows if not held_out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    found = {}
    for d, t in rows:
        words = tokens(t)
        found[d, t] = (len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    return found


def model_of(seed: int, trained: bool = True, n: int = 300):
    rng = np.random.default_rng(seed)
    classes = rng.integers(0, SMALL.classes, n)
    ends = np.unique(np.append(rng.integers(1, n, 8), n))
    pairs = attention.pair_logits(np.bincount(classes[:-1] * SMALL.classes + classes[1:], minlength=SMALL.classes**2), SMALL)
    params = {k: rng.normal(size=v.shape) * 0.3 if trained else v for k, v in attention.initial(SMALL).items()}
    return classes, ends, pairs, params


def naive(params, pairs, classes: np.ndarray, options) -> np.ndarray:
    """Log probabilities (place, class) of one text: each place by its own loop over what its window lets it see."""
    c, found = options.context, []
    for t in range(len(classes)):
        first = t // options.stride * options.stride - c
        seen = [u for u in range(max(0, first), t + 1)]
        x = [params["embed"][classes[u - 1]] + params["place"][u - first] for u in seen]
        q = x[-1] @ params["query"] * options.width**-0.5
        weight = np.exp([q @ (v @ params["key"]) for v in x])
        z = sum(w * (v @ params["value"]) for w, v in zip(weight / weight.sum(), x, strict=True))
        h = x[-1] + z @ params["mix"]
        y = h + np.maximum(h @ params["up"] + params["shift"], 0) @ params["down"]
        before = classes[t - 1]
        g = y @ params["group"] + pairs.group[before]
        g = g - np.log(np.exp(g).sum())
        rows = []
        for k in range(options.groups):
            m = y @ params["member"][k] + pairs.member[before, k]
            rows.append(g[k] + m - np.log(np.exp(m).sum()))
        found.append(np.concatenate(rows))
    return np.array(found)


def test_every_token_is_scored_once_as_by_loops():
    classes, ends, pairs, params = model_of(1)
    classes[ends - 1] = 0  # the end token
    got = attention.class_scores(params, pairs, classes, ends, SMALL)
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        text = classes[lo:hi]
        logp = naive(params, pairs, text, SMALL)
        assert np.allclose(np.exp(logp).sum(axis=1), 1)  # a probability over all classes
        assert np.allclose(got[lo:hi], logp[np.arange(len(text)), text], atol=1e-4)
    _, scored, _ = attention.windows(classes, ends, SMALL)
    assert sorted(scored[scored >= 0].tolist()) == list(range(len(classes)))


def test_gradient_equals_differences():
    classes, ends, pairs, params = model_of(2, n=120)
    pairs = attention.Pairs(pairs.group.astype(np.float64), pairs.member.astype(np.float64))
    inputs, scored, _ = attention.windows(classes, ends, SMALL)
    targets = np.where(scored >= 0, classes[np.maximum(scored, 0)], -1)
    _, found = attention.gradient(params, pairs, inputs, targets, SMALL)
    rng, step = np.random.default_rng(3), 1e-6
    for name, values in params.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in values.shape)
            losses = []
            for sign in (1, -1):
                moved = {k: v.copy() for k, v in params.items()}
                moved[name][at] += sign * step
                losses.append(attention.gradient(moved, pairs, inputs, targets, SMALL)[0])
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(found[name][at], abs=1e-6)


def test_ids_spell_the_words(monkeypatch):
    monkeypatch.setattr(lmscore, "KEPT_WORDS", 3)
    subwords, plain = lmscore.Subwords(), lmscore.Subwords()
    texts = [["the", "café", "don't", "1a2", "a\xa0", "\u3000", "x" * 5000, "\x1c"], [], ["<|endoftext|>", "the"], ["\xa0", "\xa0b", "the", "the"]]
    for _ in range(2):
        for text, data in zip(texts, subwords.ids([[w.encode() for w in t] for t in texts]), strict=True):
            ids = np.frombuffer(data, "<u2").tolist()
            assert ids[-1] == lmscore.END_ID and lmscore.END_ID not in ids[:-1]
            whole = "".join(f" {w}" for w in text)
            assert ids[:-1] == plain.encoding.encode(whole, disallowed_special=()) and subwords.encoding.decode(ids[:-1]) == whole


def test_ids_within_their_classes_are_a_probability():
    counts = np.zeros(lmscore.VOCABULARY, np.int64)
    counts[np.random.default_rng(1).integers(0, lmscore.VOCABULARY, 5000)] += 7
    classes = lmscore.token_classes(counts, attention.OPTIONS)
    assert classes.of.max() < attention.OPTIONS.classes and (classes.of == classes.of[lmscore.END_ID]).sum() == 1
    assert np.allclose(np.bincount(classes.of, np.exp(classes.within), attention.OPTIONS.classes), 1)


@pytest.mark.parametrize("clashing", [False, True])
def test_base_equals_brute_force(spark, odd_rows, clashing, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT", 64)  # both ways to a word's count
    monkeypatch.setattr(lmscore, "HELD_WORDS", 40)  # several portions a task
    rows = [(d, t.upper() if t and i % 3 else t) for i, (d, t, _) in enumerate(odd_rows)]
    held_out = crc32_of(F.col("doc_id")) % 7 == 2
    got = lmscore.language_scores(documents(spark, rows, clashing), ~held_out).join(documents(spark, rows).select("doc_id", "text").distinct(), "doc_id").collect()
    want = base(rows, lambda d: zlib.crc32(b"" if d is None else b"%d" % d) % 7 == 2)
    assert len(got) >= sum(d is not None for d, _ in rows)
    for r in got:
        n_tokens, n_known, n, score = want[r.doc_id, r.text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(score)
        assert math.isfinite(r.score) and r.score < 0


def test_rows_and_tables_without_training(spark, odd_rows):
    rows = odd_rows[:20] + odd_rows[-3:]
    scores = lmscore.language_scores(documents(spark, rows), F.lit(False)).collect()
    assert len(scores) == len(rows)
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in scores)
    assert lmscore.language_scores(documents(spark, []).limit(0), F.lit(True)).collect() == []


def test_learns_what_attention_can_see(spark):
    """Each text keeps to one of several word lists. Training lowers the loss on held-out texts, and they are likelier
    than texts that mix the lists."""
    rng = random.Random(5)
    lists = [[words(rng, 1, 10**6) for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(rng.choice(lists[i % 6]) for _ in range(rng.randrange(20, 200)))) for i in range(600)]
    rows += [(10_000 + 5 * i, " ".join(rng.choice(lists[rng.randrange(6)]) for _ in range(100))) for i in range(100)]
    found = {}
    for rate in (0.0, 1e-2):
        options = attention.AttentionOptions(every=1, batch=8, rate=rate)
        scores = lmscore.language_scores(documents(spark, rows), F.col("doc_id") % 5 != 0, options).where("doc_id % 5 = 0").collect()
        for mixed in (False, True):
            part = [r for r in scores if (r.doc_id >= 10_000) == mixed]
            found[rate, mixed] = sum(r.score for r in part) / sum(r.n_tokens for r in part)
    assert found[1e-2, False] > found[0.0, False]
    assert found[1e-2, False] > found[1e-2, True]


def test_attention_is_trained_on_every_window_of_every_training_text(spark, monkeypatch):
    """All rounds together see the tokens of all training texts, each once; null and repeated ids and empty texts too."""
    monkeypatch.setattr(lmscore, "HELD_WINDOWS", 3)
    rng = random.Random(8)
    rows = [(i % 40 if i % 9 else None, words(rng, 0, 300) if i % 7 else None) for i in range(60)]
    encoded = lmscore._encoded(documents(spark, rows), F.lit(True), {}).where("place >= 0").select("doc_id", "ids").coalesce(1)
    table = encoded.toArrow().combine_chunks().to_batches()
    classes = lmscore.TokenClasses(np.arange(lmscore.VOCABULARY), np.zeros(lmscore.VOCABULARY))
    targets = [t for number in range(attention.OPTIONS.rounds) for batch in table for _, t in lmscore._windows_of(batch, number, classes, attention.OPTIONS)]
    seen = np.concatenate([t[t >= 0] for t in targets])
    ids = np.concatenate([np.frombuffer(x, "<u2") for batch in table for x in batch.column(1).to_pylist()])
    assert len(table) and sorted(seen.tolist()) == sorted(ids.tolist())


def test_a_word_is_looked_up_once_for_each_use():
    """Encoding is bound by look-ups of words: each use costs one, a new word a few more."""
    looked_up = []

    class Word(bytes):
        def __hash__(self) -> int:
            looked_up.append(self)
            return bytes.__hash__(self)

    texts = [[Word(b"w%d" % (i * k % 7)) for k in range(200)] for i in range(10)]
    plain = [[bytes(w) for w in text] for text in texts]
    looked_up.clear()
    assert lmscore.Subwords().ids(texts) == lmscore.Subwords().ids(plain)
    assert len(looked_up) <= 2000 + 50


def test_base_and_ids_where_words_are_forgotten(spark, monkeypatch):
    """Portions that end early and words forgotten between them change nothing; a portion holds its words once."""
    monkeypatch.setattr(lmscore, "HOT", 64)
    monkeypatch.setattr(lmscore, "HELD_WORDS", 30)
    monkeypatch.setattr(lmscore, "KEPT_WORDS", 40)
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 0, 60)} n{rng.randrange(90)} N{rng.randrange(90)}" if i % 11 else None) for i in range(1200)]
    docs, training = documents(spark, rows).coalesce(1), F.col("doc_id") % 7 != 2
    counts = Counter(w for d, t in rows for w in tokens(t))
    hot = {w.encode(): float(c) for w, c in counts.items() if c > 100 or not w}
    encoded = lmscore._encoded(docs, training, hot).collect()
    found, plain = {}, lmscore.Subwords()
    for end in (r for r in encoded if r.place == -1):
        assert len(set(end.words)) == len(end.words) and not hot.keys() & {w.encode() for w in end.words}
        ends, used = np.cumsum(end.sizes), np.frombuffer(end.uses, "<i4")
        found |= {(end.portion, i): [end.words[k] for k in used[hi - n : hi]] for i, (n, hi) in enumerate(zip(end.sizes, ends, strict=True))}
    texts = dict(rows)
    assert len({r.portion for r in encoded}) > 1 and sorted(r.doc_id for r in encoded if r.place >= 0) == sorted(texts)
    for r in (r for r in encoded if r.place >= 0):
        own = tokens(texts[r.doc_id])
        assert found[r.portion, r.place] == [w for w in own[:-1] if w.encode() not in hot]
        common = [hot[w.encode()] for w in own if w.encode() in hot]
        assert (r.n_tokens, r.known, r.total) == (len(own), len(common), sum(common))
        assert bytes(r.ids) == plain.ids([[w.encode() for w in own[:-1]]])[0]
    want = base(rows, lambda d: d % 7 == 2)
    for r in lmscore.language_scores(docs, training).collect():
        n_tokens, n_known, n, score = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and r.base_score == pytest.approx(score)


def test_rounds_of_a_batch_are_those_of_its_texts():
    ids, counts = [5, None, 5, -3, 2**40], np.array([3, 0, 40, 7, 1])
    whole = lmscore._rounds(ids, counts, attention.OPTIONS)
    assert np.array_equal(whole, np.concatenate([lmscore._rounds([d], np.array([n]), attention.OPTIONS) for d, n in zip(ids, counts, strict=True)]))
    assert set(whole.tolist()) == set(range(attention.OPTIONS.rounds))


@pytest.mark.parametrize("scale", [1.0, 10.0])
def test_large_weights_are_scored_as_by_loops(scale):
    """Weights that exponentials could not hold, and the bound that tells so."""
    classes, ends, pairs, params = model_of(7, n=40)
    params |= {k: params[k] * scale for k in ("query", "key")}
    rng = np.random.default_rng(2)
    q, k = rng.normal(size=(3, 5, 6)) * scale, rng.normal(size=(3, 7, 6)) * scale
    assert (q @ k.transpose(0, 2, 1)).max() <= attention._most(q, k)
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        text = classes[lo:hi]
        logp = naive(params, pairs, text, SMALL)[np.arange(len(text)), text]
        assert np.allclose(attention.class_scores(params, pairs, text, np.array([len(text)]), SMALL), logp, atol=1e-4)
