import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest

from plumbline.llm import conversation_repair as repair
from plumbline.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, audit string, gone int"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_repair(rows):
    """Every path: the least (cost, audit) and the rows that it leaves, over rows of (role, text, fault)."""
    best = {(0, 0): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for (k, s), (cost, audit, out) in list(best.items()):
                if k == i:
                    for c, t in NEXT[s].items():
                        if c != "s":
                            new = cost + 3, audit + "I", (*out, {2: "user:", 3: "assistant:"}[t])
                            best[i, t] = min(best.get((i, t), new), new)
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 3 if fault == "truncated" else 0
            for (k, s), (cost, audit, out) in list(best.items()):
                if k != i:
                    continue
                moves = [(s, cost + 4, "D", out)]
                if fault not in ("blank", "duplicate"):
                    if role[:1] in NEXT[s]:
                        moves.append((NEXT[s][role[:1]], cost + extra, "K", (*out, f"{role}:{text}")))
                    moves += [(t, cost + 3 + extra, "R", (*out, {2: "user:", 3: "assistant:"}[t] + text)) for c, t in NEXT[s].items() if c != "s"]
                for t, c, e, o in moves:
                    new = c, audit + e, o
                    best[i + 1, t] = min(best.get((i + 1, t), new), new)
    return min(v for (k, s), v in best.items() if k == len(rows) and s in (0, 3))


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            out.append((conv, None, None, None))
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    answers = []
    for _, own in groupby(sorted(brute_damage(rows), key=key), key):
        own = list(own)
        conv = own[0][0]
        kept = sorted((r for r in own if r[2] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, count, faulty = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, turn, role, text in kept:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            faulty.append((role, text, fault))
        turns = {r[1] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, out = brute_repair(faulty)
        answers.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return answers


def answers(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(parts)
    got = repair.repaired(repair.damaged(df)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def some_rows(rng, conv, n):
    texts = ["Yes.", "no", " ", "Why? ", "ok!", "", "cut off", None, "It is.\n", "…\u0085"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    return [(conv, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)) for t in range(n)]


def test_spans_meet_like_single_paths():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randrange(0, 12))]
        codes = bytes(repair.code_of(r[:1], {None: repair.FINE, "blank": repair.MUST_GO, "truncated": repair.CUT}[f]) for r, _, f in rows)
        cost, end = repair.ending(*repair.element(np.frombuffer(codes, np.uint8)))
        audit, lines = repair.rewritten(codes, repair.START, end, [r for r, *_ in rows], [t for _, t, _ in rows], True)
        assert (cost, audit, tuple(lines)) == brute_repair(rows)


def test_small_conversations(spark):
    rng = random.Random(1)
    rows = [r for conv in (None, *range(120)) for r in some_rows(rng, conv, rng.randrange(1, 9))]
    rows += [(500, 3, "user", "Same."), (500, 3, "user", "Same."), (500, 3, "assistant", "Same."), (500, 9, "user", "Same.")]
    assert answers(spark, rows) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    rng = random.Random(2)
    rows = some_rows(rng, 7, 900) + [(7, 10_000 + k, "user", "Hot.") for k in range(300)] + [r for c in (1, 9) for r in some_rows(rng, c, 5)]
    want = brute(rows)
    assert answers(spark, rows) == want
    monkeypatch.setattr(repair, "CHUNK_ROWS", 7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert answers(spark, rows, 5) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert answers(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in table(spark, f"/root/testdata/sf{sf}", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, repair.query(spark, f"/root/testdata/sf{sf}").collect()))
    assert got == brute(rows)
