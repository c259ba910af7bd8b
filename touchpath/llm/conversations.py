"""Conversation structure repair: generalised LR parse of the roles with weighted edits.

Rows are sorted by conversation and turn on the executors and pass a task as a stream. Per conversation one repair
(``rolegrammar.Repair``) keeps a survivor per stack top; edits on which all survivors agree are applied and forgotten, so
the texts of a long conversation are not held. A conversation has one hash over all its rows, so one task reads it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpath.llm.common import text_batches
from touchpath.llm.rolegrammar import COSTS, DELETE, INSERT, KEEP, Costs, Repair

_BLANKS = " \t\n\v\f\r"
_ENDS = ".!?"
_LEGAL = {"su", "ua", "au"}
_TERMINALS = {"s", "u", "a"}
#: Rows that wait before edits in common are looked for.
_HELD = 256

EDITS = "place long, action string, turn long, role string, text string"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with null roles and texts as one space and damage dealt by crc32(``conv_id:turn``) % 20.

    0 marks the row ``gone``, 1 empties the text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats the row, 4 sets role user.
    """
    code = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, _ENDS, "")).otherwise(text).alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``gone``, ``again``: each conversation whole in one task, by turn.

    One exchange: the window's finer key is met by the partitioning on ``conv_id``.
    """
    whole = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    again = whole.selectExpr("*", "row_number() OVER (PARTITION BY conv_id, gone, role, text ORDER BY turn NULLS FIRST) > 1 AS again")
    return again.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


class Conversation:
    """One conversation on its way through a task."""

    def __init__(self, costs: Costs = COSTS) -> None:
        self.repair = Repair(costs=costs)
        self.waiting: deque[tuple[int | None, str, str]] = deque()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.rows = self.illegal = self.turns = 0
        self.first = self.last = None
        self.before = ""
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.place = self.written = 0
        self.spoken = ""

    def add(self, turn: int | None, role: str, text: str, again: bool) -> list[tuple]:
        """Takes the next row; returns the edits that are certain by now."""
        bare = text.rstrip(_BLANKS)
        fault = "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in _ENDS else None
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += self.rows > 0 and self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        self.rows += 1
        self.waiting.append((turn, role, text))
        self.repair.row(role[:1] if role[:1] in _TERMINALS else None, fault in ("blank", "duplicate"), fault == "truncated")
        return self._apply(self.repair.settled()) if len(self.waiting) % _HELD == 0 else []

    def _apply(self, audit: str) -> list[tuple]:
        edits = []
        self.audit.append(audit)
        for action in audit:
            turn, role, text = (None, "", "") if action == INSERT else self.waiting.popleft()
            if action != DELETE:
                if action != KEEP:
                    role = "assistant" if self.spoken == "u" else "user"
                self.spoken = role[0]
                self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
                self.written += 1
            edits.append((self.place, action, turn, role, text))
            self.place += 1
        return edits

    def finish(self) -> tuple[list[tuple], tuple]:
        """The last edits and the report of the conversation."""
        cost, audit = self.repair.finish()
        edits = self._apply(audit)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return edits, (gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def _pass(rows: DataFrame, costs: Costs, schema: str, chosen: Callable[[list[tuple], tuple | None], list[tuple]]) -> DataFrame:
    """Streams ordered ``rows`` through a ``Conversation`` each; ``chosen`` picks the output of (edits, report)."""
    conv_id = rows.schema["conv_id"].dataType.simpleString()

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conversation, out, kind = None, None, [], None

        def close() -> None:
            out.extend((current, *row) for row in chosen(*conversation.finish()))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conversation is None or key != current:
                    if conversation is not None:
                        close()
                    current, conversation = key, Conversation(costs)
                if not gone:
                    out.extend((current, *row) for row in chosen(conversation.add(turn, role, text, again), None))
            yield flushed()
        if conversation is not None:
            close()
            yield flushed()

    names = ["conv_id", *(c.split()[0] for c in schema.split(", "))]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    return text_batches(_ordered(rows)).mapInArrow(repair, f"conv_id {conv_id}, {schema}")


def _rows(conversations: DataFrame) -> DataFrame:
    wanted = ["conv_id", "turn", "role", "text"]
    return conversations.select(*wanted, "gone") if "gone" in conversations.columns else conversations.select(*wanted, F.lit(False).alias("gone"))


def repair_edits(conversations: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """Every edit in order: ``conv_id``, ``place``, ``action`` (K, R, D, I), ``turn``, ``role`` and ``text`` after it.

    The rows whose action is not D are the repaired conversation. Nulls, ties and empty tables as in ``repair_report``.
    """
    return _pass(_rows(conversations), costs, EDITS, lambda edits, report: edits)


def repair_report(conversations: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and hash of the repaired rows.

    Reads ``conv_id``, ``turn``, ``role``, ``text`` and, where there is one, ``gone`` (rows that count for nothing but keep
    their conversation in the result); other columns are not read. Rows with a null ``conv_id`` are one conversation. Null
    turns come first; rows of one turn are ordered by role and text. A null or empty text is blank, a role of another
    initial cannot be kept, an empty conversation needs no edit. An empty table gives no rows. Texts of any length are
    judged whole. Memory per conversation: its audit, and the rows on which the survivors still differ.
    """
    return _pass(_rows(conversations), costs, REPORT, lambda edits, report: [report] if report else [])
