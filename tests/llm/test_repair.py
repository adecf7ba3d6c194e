"""Conversation repair against a search over all edits, with conversations cut into tiny segments and long hot ones."""

import hashlib
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import repair
from tallyfold.llm.queries import damaged
from tallyfold.llm.repair import repair_conversations, repaired_turns

ROLES = ["system", "user", "assistant", "tool", "", "ulysses", None]
TEXTS = ["Yes.", "No", " ", "", None, "Why? ", "ok!\n", "again.", "\x0b\x0c", "x "]


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    counts, seen, judged, prev = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, set(), [], None
    for _, role, text in rows:
        counts["illegal"] += prev is not None and prev + role[:1] not in ("su", "ua", "au")
        prev, said = role[:1], text.strip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault))

    @cache
    def best(i, built, inserted):
        """Cheapest (cost, audit, lines) for the rest, after the initials ``built`` (only how they may go on matters)."""
        options = []
        if i == len(judged) and built in ("", "a"):
            options.append((0, "", ()))
        expected = {"": "user", "s": "user", "u": "assistant", "a": "user"}[built]

        def then(cost, letter, line, j, now, ins):
            rest = best(j, now, ins)
            if rest:
                options.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if inserted < 3:
            then(3, "I", (expected + ":",), i, expected[0], inserted + 1)
        if i < len(judged):
            role, text, fault = judged[i]
            then(4, "D", (), i + 1, built, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] == expected[0] or (built == "" and role[:1] == "s"):
                    then(more, "K", (f"{role}:{text}",), i + 1, role[:1], 0)
                then(3 + more, "R", (f"{expected}:{text}",), i + 1, expected[0], 0)
        return min(options, default=None)

    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    for i in range(len(judged), -1, -1):  # from the back, so that no call goes deep
        for built in ("", "s", "u", "a"):
            best(i, built, 0)
    cost, audit, lines = best(0, "", 0)
    return (gaps, *counts.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), list(lines)


def plain_all(rows):
    """rows: (conv_id, turn, role, text, copies)."""
    by = {}
    for conv, turn, role, text, copies in rows:
        by.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: plain_repair(sorted(turns, key=order)) for conv, turns in by.items()}


def made_rows(seed, convs, length):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for _ in range(rng.randrange(length)):
            turn = None if rng.random() < 0.1 else rng.randrange(9)
            role = rng.choice(ROLES) if rng.random() < 0.3 else rng.choice(ROLES[:3])
            rows.append((conv if conv else None, turn, role, rng.choice(TEXTS), rng.choice([0, 1, 1, 1, 2])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, copies int"


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_against_a_search_over_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    rows = made_rows(segment, 60, 9)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("kept") for c in ("seg", "rows", "gaps", "audit")})
    want = plain_all(rows)
    out = repair_conversations(frame, F.col("copies"))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    assert out.count() == len(want) and got == {c: report for c, (report, _) in want.items()}
    turns = {}
    for r in sorted(repaired_turns(frame, F.col("copies")).collect(), key=lambda r: r["position"]):
        assert r["position"] == len(turns.setdefault(r["conv_id"], []))
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert turns == {c: lines for c, (_, lines) in want.items() if lines}


def test_a_hot_conversation_is_spread_over_partitions(spark, monkeypatch):
    """A third of all rows in one conversation, with a text of a thousand turns and rows equal in all columns."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 16)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(ROLES[:3]), "Same." if t % 3 else f"Said {t}" + rng.choice([".", ""]), 1) for t in range(700)]
    rows += [(7, 350, "user", "Copy.", 1)] * 200 + [(7, None, "user", "No turn.", 1)] * 30
    rows += [(100 + i // 4, i % 4, ("user", "assistant")[i % 2], f"Text {i}.", 1) for i in range(1200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spread = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(frame).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    assert got == {c: report for c, (report, _) in plain_all(rows).items()}


def test_empty_table_long_text_and_conversations_without_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).collect() == [] and repaired_turns(empty).collect() == []
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "user", long, 1), (1, 1, "assistant", "Yes.", 1), (2, 5, "user", "gone", 0)]
    got = {r["conv_id"]: r for r in repair_conversations(spark.createDataFrame(rows, SCHEMA), F.col("copies")).collect()}
    assert got[1]["audit"] == "KK" and got[1]["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_follows_the_contract(spark):
    import zlib

    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in [("system", "A. b! c? d"), (None, None)]]
    got = sorted(map(tuple, damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if harm == 1 else "".join(ch for ch in x if ch not in ".!?") if harm == 2 else x
        want.append((c, t, "user" if harm == 4 else r, x, {0: 0, 3: 2}.get(harm, 1)))
    assert got == sorted(want, key=repr)
