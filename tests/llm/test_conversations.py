from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from touchpath.llm import conversations
from touchpath.llm.rolegrammar import Automaton, Stacks

WORD = re.compile(r"[^\x20\x09-\x0D]")
ROLES = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows: list[tuple[str, str, str | None]]) -> tuple[int, str, list]:
    """Uniform-cost search over (rows read, roles written); knows nothing of stacks or automata."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, read, roles, kept = heapq.heappop(todo)
        if read == len(rows) and ROLES.match(roles):
            return cost, audit, list(kept)
        # What was written matters only by its last role and by whether a system row may still come.
        state = (read, "" if not roles else "s" if roles == "s" else roles[-1])
        if state in done:
            continue
        done.add(state)

        def write(more: int, action: str, role: str, text: str, step: int) -> None:
            made = roles + role[:1]
            if len(role) and re.match(r"s?(ua)*u?\Z", made):
                heapq.heappush(todo, (cost + more, audit + action, read + step, made, (*kept, (role, text))))

        for role in ("user", "assistant"):
            write(2, "I", role, "", 0)
        if read < len(rows):
            role, text, fault = rows[read]
            heapq.heappush(todo, (cost + 3, audit + "D", read + 1, roles, kept))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                write(extra, "K", role, text, 1)
                for other in ("user", "assistant"):
                    write(2 + extra, "R", other, text, 1)
    raise AssertionError("every conversation can be emptied")


def brute(original: list[tuple]) -> dict:
    """Report per conversation of (conv_id, turn, role, text) rows."""
    text_of = lambda x: " " if x is None else str(x)
    found = {}
    for conv in {r[0] for r in original}:
        rows = []
        for _, turn, role, text in (r for r in original if r[0] == conv):
            role, text = text_of(role), text_of(text)
            code = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
            rows += [(turn, role, text)] * (2 if code == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, seen = [], set()
        for _, role, text in rows:
            full = WORD.findall(text)
            fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, kept = cheapest(judged)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == x for _, _, f in judged) for x in ("blank", "duplicate", "truncated")),
            sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return found


def report(df) -> dict:
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def made(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Unser", "a"]
    texts = ["Fine.", "Oh!", "cut off", " ", "", None, "\n\t", "Well? ", "é…", "x. "]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(0, 14)):
            turn += rng.choice([0, 1, 1, 1, 3])
            clean = rng.random() < 0.6
            role = roles[turn % 2] if clean else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, f"Line {turn}." if clean else rng.choice(texts)))
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_equals_search(spark, clashing):
    rows = made(3, 300)
    rows += [(None, t, r, x) for t, r, x in [(None, None, None), (0, "user", "Hi."), (1, "assistant", "Yes."), (0, "user", "Hi.")]]
    rows += [(1000, 5, "user", "A."), (1000, 5, "user", "A."), (1001, 0, "system", "S."), (1002, 0, None, "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        df = df.selectExpr("*", "1 AS code", "2 AS cost", "'x' AS audit", "3 AS again", "4 AS _copy", "5 AS place")
    assert report(conversations.repair_report(conversations.damaged(df))) == brute(rows)


def test_edits_are_the_repaired_conversation(spark):
    rows = conversations.damaged(spark.createDataFrame(made(5, 60), SCHEMA))
    want = report(conversations.repair_report(rows))
    edits: dict = {}
    for r in conversations.repair_edits(rows).collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, found in want.items():
        ordered = sorted(edits.get(conv, []), key=lambda r: r.place)
        assert "".join(r.action for r in ordered) == found[6]
        kept = [r for r in ordered if r.action != "D"]
        assert ROLES.match("".join(r.role[0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == found[7]


@pytest.mark.parametrize("pattern", ["ua", "u", "s", "sua", "t", "aau"])
def test_long_conversations_settle_as_they_pass(pattern):
    """Rows held stay few where the survivors agree; results equal the search in any case."""
    rng = random.Random(8)
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(names[pattern[i % len(pattern)]], f"row {i}" + rng.choice([".", ".", ""])) for i in range(1500)]
    one, held = conversations.Conversation(), 0
    for i, (role, text) in enumerate(rows):
        one.add(i, role, text, False)
        held = max(held, len(one.waiting))
    _, found = one.finish()
    judged = [(r, t, None if t.endswith(".") else "truncated") for r, t in rows]
    cost, audit, kept = cheapest(judged)
    assert found[5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    assert held <= 600 or pattern in "ut"  # one role alone: which rows to keep depends on the end


def test_stacks_accept_the_language():
    stacks = Stacks(Automaton())
    for n in range(8):
        for code in range(3**n):
            word = "".join("sua"[code // 3**i % 3] for i in range(n))
            tops = [stacks.start]
            for x in word:
                tops = [b for a in tops for b in stacks.shift(a, x)]
            assert any(map(stacks.accepts, tops)) == bool(ROLES.match(word))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_report(conversations.damaged(empty)).collect() == []
    assert conversations.repair_edits(empty).collect() == []
