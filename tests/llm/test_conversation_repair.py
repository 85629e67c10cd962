"""Conversation repair against a plain search over all edits with whole audit strings."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from coinbrook.llm import convrepair

BLANKS = " \t\n\x0b\x0c\r"
KEPT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, lines): every edit of every row, with whole strings."""
    seen, best, counts = set(), {"": (0, "", ())}, Counter()
    inserted = lambda s, v: (NEXT[s], (v[0] + 5, v[1] + "I", (*v[2], ROLE[NEXT[s]] + ":")))

    def put(into, s, v):
        if s not in into or v[:2] < into[s][:2]:
            into[s] = v

    def with_inserts(layer):
        out = {}
        for s, v in layer.items():
            for _ in range(4):
                out.setdefault(s, []).append(v)
                s, v = inserted(s, v)
        return out

    for role, text in rows:
        core = text.rstrip(BLANKS)
        fault = "blank" if not core.lstrip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        new = {}
        for s, many in with_inserts(best).items():
            for c, a, lines in many:
                put(new, s, (c + 2, a + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 * (fault == "truncated")
                if (s, role[:1]) in KEPT:
                    put(new, KEPT[s, role[:1]], (c + more, a + "K", (*lines, f"{role}:{text}")))
                put(new, NEXT[s], (c + 1 + more, a + "R", (*lines, f"{ROLE[NEXT[s]]}:{text}")))
        best = new
    final = {}
    for s, many in with_inserts(best).items():
        for v in many:
            if s in ("", "a"):
                put(final, 0, v)
    return (*final[0], counts)


def expected(rows):
    out = Counter()
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines, counts = cheapest([r[1:] for r in own])
        out[conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def answer(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS conv", "1 AS n", "'x' AS head")
    return Counter(map(tuple, convrepair.repair(df).collect()))


def generated(seed, n, longest=12):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "A long answer. With no end", "Stop! \n", "", " \t", None, "tail.\x0b\r", "Go."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", None, "", "user"]
    out = []
    for conv in [*range(n), None]:
        for turn in range(rnd.randrange(1, longest)):
            text = rnd.choice([*texts, f"text {turn}.", f"text {turn}"])
            out.append((conv, rnd.choice([turn, turn, turn, None, turn * 3]), ("user", "assistant")[turn % 2] if rnd.random() < 0.5 else rnd.choice(roles), text))
    return out


@pytest.mark.parametrize("block", [1, 3, 1 << 14])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(convrepair, "BLOCK", block)
    rows = generated(block, 60)
    assert answer(spark, rows) == expected(rows)


def test_a_conversation_over_many_tasks(spark, monkeypatch):
    """One conversation holds most rows: it is solved in parts, also where one text fills it."""
    monkeypatch.setattr(convrepair, "BLOCK", 7)
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "assistant", "system"]), "same." if t % 3 else f"turn {t}" + rnd.choice([".", ""])) for t in range(900)] + generated(4, 5)
    rows = [(9 if c is None else c + 2 if c != 1 else 1, *r) if i >= 900 else (c, *r) for i, (c, *r) in enumerate(rows)]
    assert answer(spark, rows) == expected(rows)


def test_small_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = Counter(map(tuple, convrepair.repair(df).collect()))
    assert got == expected([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]) and len(got) == 20


def test_dropped_whole_and_empty(spark):
    turn = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert answer(spark, [(5, turn, "user", "x.")]) == Counter([(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())])
    none = convrepair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0 and none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_codes_are_ordered_and_free_of_prefixes():
    assert list(convrepair.CODES) == sorted(convrepair.CODES)
    assert not any(a != b and b.startswith(a) for a in convrepair.CODES for b in convrepair.CODES)
