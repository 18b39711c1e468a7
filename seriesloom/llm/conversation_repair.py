"""The cheapest repair of the turns of conversations, in one ordered pass.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles: perhaps a system
turn, then user and assistant in turn, ended by the assistant; or nothing at all. Every row is
kept (0), given the role user or assistant (2) or deleted (3, the only choice for a blank or
repeated row); empty turns of user or assistant may be inserted anywhere (2); a truncated row
that stays costs 1. Of the cheapest repairs that with the ASCII-least string of edits counts.

The rows are partitioned by conversation and sorted by turn within. A dynamic program over the
four states of the pattern runs along them and is carried from one Arrow batch to the next:
per state a cost, a running SHA-256 of what the repaired conversation would be so far, and a
rank among the strings of edits that lead there. Costs count from the least and states that
cannot win are dropped, so few different situations exist; each transition is worked out once
and a row leaves the number of its transition as backpointer. Those numbers go to a file of the
task beyond a million rows, and texts that are to be returned go there too beyond a few
megabytes: a giant conversation takes its time, as its digest is sequential, but no memory.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or reroled turn has after a state, and the inserts that end a conversation there.
FORCED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Any state follows any continuation of another one for at most this much more: two inserts and a delete.
SLACK = 2 * INSERT + DELETE
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
BACKPOINTERS, TEXT_BYTES, OUT_ROWS = 1 << 20, 8 << 20, 4096

Costs = tuple[int | None, ...]


def advance(costs: Costs, ranks: tuple[int, ...], initial: str, fault: int) -> tuple[int, Costs, tuple[int, ...], tuple]:
    """One row: what the least cost grows by, costs above it, ranks, and per state the (state before, edits)."""
    best: dict[int, tuple] = {}
    for source, cost in enumerate(costs):
        if cost is None:
            continue
        state, edits = source, ""
        for _ in range(3):  # a third insert would only come back to a state
            found = [(state, cost + DELETE, "D")]
            if fault < DUPLICATE:
                cut = CUT * (fault == TRUNCATED)
                if (state, initial) in NEXT:
                    found.append((NEXT[state, initial], cost + cut, "K"))
                found.append((NEXT[state, FORCED[state][0]], cost + REROLE + cut, "R"))
            for to, total, edit in found:
                # No string before a row is the begin of another one, so ranks decide between sources.
                key = (total, ranks[source], edits + edit, source)
                if to not in best or key < best[to]:
                    best[to] = key
            state, cost, edits = NEXT[state, FORCED[state][0]], cost + INSERT, edits + "I"
    least = min(key[0] for key in best.values())
    best = {to: key for to, key in best.items() if key[0] <= least + SLACK}
    order = {to: rank for rank, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    return (
        least,
        tuple(best[q][0] - least if q in best else None for q in range(4)),
        tuple(order.get(q, 0) for q in range(4)),
        tuple((best[q][3], best[q][2]) if q in best else None for q in range(4)),
    )


class Steps:
    """All transitions met so far, by number; one table per task."""

    def __init__(self):
        self.moves, self._known = [], {}

    def __call__(self, situation: tuple, initial: str, fault: int) -> tuple[int, tuple, int]:
        """Growth of the least cost, the situation after the row, the number of the moves."""
        key = situation, initial if initial in ("s", "u", "a") else "", fault
        if key not in self._known:
            growth, costs, ranks, moves = advance(*situation, *key[1:])
            self._known[key] = growth, (costs, ranks), len(self.moves)
            self.moves.append(moves)
        return self._known[key]


def line(role: str, text: str, first: bool) -> bytes:
    return f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass")


class Conversation:
    """What is known of the conversation whose rows are coming."""

    def __init__(self, conv: str | None, steps: Steps, keep_texts: bool):
        self.conv, self._steps = conv, steps
        self.rows = self.illegal = self.cost = 0
        self.faults = [0, 0, 0, 0]
        self.turns, self.low, self.high = 0, None, None
        self._last = None
        self._situation = (0, None, None, None), (0, 0, 0, 0)
        self._digests = [(hashlib.sha256(), True), None, None, None]  # (digest, nothing written yet)
        self._back, self._spilled = array("I"), None
        self._texts = tempfile.SpooledTemporaryFile(TEXT_BYTES) if keep_texts else None
        self._lengths = array("q")

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.rows and self._last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self._last, self.rows = initial, self.rows + 1
        self.faults[fault] += 1
        growth, self._situation, number = self._steps(self._situation, initial, fault)
        self.cost += growth
        self._digests = [move and self._follow(move, role, text) for move in self._steps.moves[number]]
        self._back.append(number)
        if len(self._back) >= BACKPOINTERS:
            self._spilled = self._spilled or tempfile.TemporaryFile()
            self._spilled.write(self._back.tobytes())
            self._back = array("I")
        if self._texts is not None:
            raw = [part.encode("utf-8", "surrogatepass") for part in ("" if turn is None else str(turn), role, text)]
            self._lengths.extend(map(len, raw))
            self._texts.write(b"".join(raw))

    def _follow(self, move: tuple[int, str], role: str, text: str) -> tuple:
        state, edits = move
        digest, first = self._digests[state]
        if edits != "D":
            digest = digest.copy()
        for edit in edits:
            if edit != "D":
                name = role if edit == "K" else FORCED[state]
                digest.update(line(name, "" if edit == "I" else text, first))
                first, state = False, NEXT[state, name[0]]
        return digest, first

    def _numbers(self) -> Iterator[int]:
        """The backpointers, last row first."""
        yield from reversed(self._back)
        if self._spilled is not None:
            size = BACKPOINTERS * self._back.itemsize
            for at in range(self._spilled.seek(0, 2) - size, -1, -size):
                self._spilled.seek(at)
                yield from reversed(array("I", self._spilled.read(size)))

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the cheapest repair."""
        costs, ranks = self._situation
        total, _, state = min((cost + INSERT * TO_END[q], ranks[q], q) for q, cost in enumerate(costs) if cost is not None)
        digest, first = self._digests[state]
        at, digest = state, digest.copy()
        audit = bytearray(b"I" * TO_END[state])
        for _ in range(TO_END[state]):
            digest.update(line(FORCED[at], "", first))
            first, at = False, NEXT[at, FORCED[at][0]]
        for number in self._numbers():
            state, edits = self._steps.moves[number][state]
            audit += edits[::-1].encode()
        audit.reverse()
        return self.cost + total, audit.decode(), digest.hexdigest()

    def summary(self) -> tuple:
        cost, audit, digest = self.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit, digest)

    def repaired(self) -> Iterator[tuple]:
        """The rows of the repaired conversation and the deleted ones, in order."""
        _, audit, _ = self.finish()
        self._texts.seek(0)
        state, place, lengths = START, 0, iter(self._lengths)
        for edit in audit:
            turn, role, text = None, "", ""
            if edit != "I":
                turn, role, text = (self._texts.read(next(lengths)).decode("utf-8", "surrogatepass") for _ in range(3))
            name = role if edit in "KD" else FORCED[state]
            yield self.conv, None if edit == "D" else place, int(turn) if turn else None, edit, name, text
            if edit != "D":
                state, place = NEXT[state, name[0]], place + 1


def _stream(frames: Iterator[pd.DataFrame], keep_texts: bool) -> Iterator[Conversation]:
    steps, current = Steps(), None
    for frame in frames:
        for conv, present, known, turn, role, text, fault in zip(*(frame[c].tolist() for c in frame.columns)):
            if current is None or conv != current.conv:
                if current is not None:
                    yield current
                current = Conversation(conv, steps, keep_texts)
            if present:
                current.add(turn if known else None, role, text, fault)
    if current is not None:
        yield current


def _ordered(turns: DataFrame, conversation: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """All rows by conversation, in order, each with its first fault; one shuffle."""
    blanks = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"
    here = F.col(present) if present else F.lit(True)
    rows = turns.select(
        F.col(conversation).cast("string").alias("conv"),
        here.alias("present"),
        (here & F.col(turn).isNotNull()).alias("known"),
        F.when(here, F.coalesce(F.col(turn).cast("bigint"), F.lit(0))).otherwise(0).alias("turn"),
        F.when(here, F.coalesce(F.col(role).cast("string"), F.lit(" "))).otherwise("").alias("role"),
        F.when(here, F.coalesce(F.col(text).cast("string"), F.lit(" "))).otherwise("").alias("text"),
    ).repartition("conv")
    same = Window.partitionBy("conv", "present", "role", "text").orderBy("known", "turn")
    last = F.expr(f"right(rtrim({blanks}, text), 1)")
    fault = F.when(last == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.withColumn("fault", fault).sortWithinPartitions("conv", "present", "known", "turn", "role", "text")


def _with_id(turns: DataFrame, conversation: str, out: DataFrame) -> DataFrame:
    kind = turns.select(conversation).schema[0].dataType
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def audit_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``audit`` has the initials of the edits (Keep, Rerole, Delete, Insert) in order; the digest
    is that of the repaired ``role:text`` lines joined by line ends. Null roles and texts are one
    space, null turns come first and count for no gap, a null id is a conversation like others.
    Rows of one turn are ordered by role and text; equal rows are repeats of the first one. Rows
    where ``present`` is false tell only that the conversation exists: without any other its
    counts are 0, its audit is empty and its digest that of no bytes. Texts and conversations may be of any
    length; other columns are not read; an empty table gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        out = []
        for conversation in _stream(frames, False):
            out.append(conversation.summary())
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    kinds = "conv_id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _with_id(turns, conversation, _ordered(turns, conversation, turn, role, text, present).mapInPandas(run, kinds))


def repair_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """The repaired turns ``conv_id, place, turn, edit, role, text``, deleted rows with a null place.

    ``place`` counts the turns of the repaired conversation from 0; inserted turns have no
    ``turn``. Which rows these are, and what nulls and ties mean, is said at :func:`audit_conversations`.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out, size = ["conv_id", "place", "turn", "edit", "role", "text"], [], 0
        for conversation in _stream(frames, True):
            for row in conversation.repaired():
                out.append(row)
                size += len(row[-1])
                if len(out) >= OUT_ROWS or size >= TEXT_BYTES:
                    yield pd.DataFrame(out, columns=names).astype({"place": "Int64", "turn": "Int64"})
                    out, size = [], 0
        yield pd.DataFrame(out, columns=names).astype({"place": "Int64", "turn": "Int64"})

    kinds = "conv_id string, place bigint, turn bigint, edit string, role string, text string"
    return _with_id(turns, conversation, _ordered(turns, conversation, turn, role, text, present).mapInPandas(run, kinds))
