import hashlib
import random
import re

import pytest

from seriesloom.llm import conversation_repair
from seriesloom.llm.conversation_repair import Conversation, Steps, audit_conversations, repair_conversations
from seriesloom.llm.q_conversation_repair import damaged, op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, edit string, audit string, conv string"
BEGIN = re.compile(r"(s?(ua)*u?)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edits tried: the least (cost, audit) and its lines."""
    best = None

    def go(i, inserted, initials, cost, audit, lines):
        nonlocal best
        if best and cost > best[0] or not BEGIN.fullmatch(initials):
            return
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, inserted + 1, initials + role[0], cost + 2, audit + "I", [*lines, f"{role}:"])
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
            return
        _, role, text = rows[i]
        go(i + 1, 0, initials, cost + 3, audit + "D", lines)
        if faults[i] in ("", "truncated"):
            cut = faults[i] == "truncated"
            if role[:1] in ("s", "u", "a"):
                go(i + 1, 0, initials + role[0], cost + cut, audit + "K", [*lines, f"{role}:{text}"])
            for name in ("user", "assistant"):
                go(i + 1, 0, initials + name[0], cost + 2 + cut, audit + "R", [*lines, f"{name}:{text}"])

    go(0, 0, "", 0, "", [])
    return best


def brute(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = faults_of(rows)
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(rows, faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def random_turns(rng):
    return [
        (rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["a.", "b!", "c", " \t", "", None, "d\n?\n", "e."]))
        for _ in range(rng.randint(0, 5))
    ]


def test_against_all_edits(spark):
    rng = random.Random(2)
    conversations = {c: random_turns(rng) for c in [None, *range(150)]}
    rows = [(c, *t, "p", "e", "a", "c") for c, turns in conversations.items() for t in turns]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r[0]: tuple(r)[1:] for r in audit_conversations(frame).collect()}
    expected = {c: brute(turns) for c, turns in conversations.items() if turns}
    assert found == {c: e for c, (e, _) in expected.items()}
    repaired = {}
    for r in sorted(repair_conversations(frame).filter("place IS NOT NULL").collect(), key=lambda r: r["place"]):
        repaired.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert repaired == {c: lines for c, (_, lines) in expected.items() if lines}


def test_edits_of_rows(spark):
    rows = [(1, 4, "user", "x."), (1, 5, "user", "  "), (1, 7, "system", "y"), (2, 8, "user", "z.")]
    found = repair_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert found.schema["conv_id"].dataType.simpleString() == "int"
    assert sorted((r["turn"] or 9, r["edit"], r["role"], r["place"]) for r in found.collect()) == [(4, "K", "user", 0), (5, "D", "user", None), (7, "R", "assistant", 1), (8, "K", "user", 0), (9, "I", "assistant", 1)]


def test_absent_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x", False), (2, None, None, None, True)], "conv_id bigint, turn bigint, role string, text string, present boolean")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, audit_conversations(frame, present="present").collect())) == [(1, 0, 0, 0, 0, 0, 0, "", empty), (2, 0, 1, 0, 0, 0, 3, "D", empty)]
    assert audit_conversations(frame.limit(0)).count() == 0 == repair_conversations(frame.limit(0)).count()


def test_giant_conversation_spills(monkeypatch):
    """More rows than fit the backpointers and texts in memory; the same result as with all in memory."""
    rng, ends = random.Random(3), []
    rows = [(i // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "bcd", ""]), rng.choice([0, 0, 0, 1, 3])) for i in range(20_011)]
    for backpointers, text_bytes in ((1 << 20, 8 << 20), (1000, 500)):
        monkeypatch.setattr(conversation_repair, "BACKPOINTERS", backpointers)
        monkeypatch.setattr(conversation_repair, "TEXT_BYTES", text_bytes)
        conversation = Conversation("c", Steps(), True)
        for row in rows:
            conversation.add(*row)
        ends.append((conversation.summary(), list(conversation.repaired())))
        assert bool(conversation._spilled) == (backpointers == 1000)
    assert ends[0] == ends[1]
    cost, audit, digest = conversation.finish()
    lines = [f"{r[4]}:{r[5]}" for r in ends[0][1] if r[1] is not None]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digest
    paid = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit)
    kept = iter(rows)
    assert cost == paid + sum(next(kept)[3] == 1 and e != "D" for e in audit if e != "I")


def test_few_situations():
    """However long the conversation, transitions are worked out a bounded number of times."""
    rng, steps = random.Random(4), Steps()
    situation = (0, None, None, None), (0, 0, 0, 0)
    sizes = []
    for _ in range(200_000):
        situation = steps(situation, rng.choice("suax"), rng.randrange(4))[1]
        sizes.append(len(steps.moves))
    assert sizes[-1] == sizes[100_000] < 500


def test_batches_of_one_conversation(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice([f"t{i}.", f"t{i}"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = audit_conversations(frame).first()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert audit_conversations(frame).first() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("kind", range(5))
def test_every_damage(spark, kind):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == kind)
    found = [tuple(r) for r in damaged(spark.createDataFrame([(3, turn, "assistant", "a. b!")], "conv_id bigint, turn bigint, role string, text string")).drop("copy", "conv_id", "turn").collect()]
    same = ("assistant", "a. b!", True)
    assert found == [[("assistant", "a. b!", False)], [("assistant", "", True)], [("assistant", "a b", True)], [same, same], [("user", "a. b!", True)]][kind]


def test_query_against_brute_force(spark, small):
    turns = {}
    for r in damaged(spark.read.parquet(f"{small}/conversations.parquet")).filter("present").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    found = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, small).collect()}
    short = {c: t for c, t in turns.items() if len(t) <= 6}
    assert len(short) > 10 and {c: found[c] for c in short} == {c: brute(t)[0] for c, t in short.items()}
