"""Lifecycles against plain folds, and refusals."""

import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from coinbrook.operators import lifecycles

DECISIONS = "signature string, name string, status string, cadence string, tolerance_days int, detector_version string"


def test_log_is_a_stack(spark):
    rnd = random.Random(4)
    events = [(f"a{rnd.randrange(25)}", i, rnd.choice(["confirm", "reject", "edit", "unlink", "undo", "undo"])) for i in range(400)]
    stacks = {}
    for a, seq, action in events:
        stack = stacks.setdefault(a, [])
        if action != "undo":
            stack.append((seq, action))
        elif stack:
            stack.pop()
    df = spark.createDataFrame(events, "aggregate_id string, seq long, action string")
    assert sorted((r.aggregate_id, r.seq) for r in lifecycles.standing(df).collect()) == sorted((a, s) for a, stack in stacks.items() for s, _ in stack)
    want = {a: (next((lifecycles.LINK_STATUS[x] for _, x in reversed(s) if x in lifecycles.LINK_STATUS), None), s[-1][1], len(s)) for a, s in stacks.items() if s}
    assert {r.aggregate_id: (r.status, r.last_action, r.n_standing) for r in lifecycles.state(df, lifecycles.LINK_STATUS).collect()} == want
    assert lifecycles.state(df.limit(0), lifecycles.LINK_STATUS).count() == 0


def test_confirmations_one_after_another(spark):
    rnd, day = random.Random(8), date(2026, 7, 1)
    pairs = {f"{a}:{b}": (a, b) for a, b in ((rnd.randrange(12), 12 + rnd.randrange(12)) for _ in range(40))}
    ledger = [(i, i % 3, day, D(i), "void" if i == 5 else "posted") for i in range(24)]
    row = lambda s, a, b: (s, rnd.random() < 0.1, a, a % 3, day, D(a), b, b % 3, day, D(b) + (b == 15))
    proposals = [row(s, a, b) for s, (a, b) in pairs.items()]
    links = [("7:20", "confirmed", 7, 20), ("1:13", "rejected", 1, 13)]
    commands = [(i, rnd.choice([*pairs])) for i in range(60)] + [(60, "none")]
    want, used = {}, {7: "7:20", 20: "7:20"}
    ambiguous = {p[0]: p[1] for p in proposals}
    for seq, s in commands:
        a, b = pairs.get(s, (None, None))
        want[seq] = "unknown" if a is None else "ambiguous" if ambiguous[s] else "stale" if a == 5 or b == 15 else "reused" if {used.get(a, s), used.get(b, s)} != {s} else None
        if want[seq] is None:
            used[a] = used[b] = s
    side = lambda n: f"{n}_id long, {n}_account long, {n}_date date, {n}_amount decimal(18,2)"
    got = lifecycles.judged_confirmations(spark.createDataFrame(commands, "seq long, signature string"), spark.createDataFrame(proposals, f"signature string, is_ambiguous boolean, {side('outflow')}, {side('inflow')}"), spark.createDataFrame(ledger, "txn_id long, account_id long, posted_date date, amount decimal(18,2), status string"), spark.createDataFrame(links, "signature string, status string, outflow_id long, inflow_id long"))
    assert {r.seq: r.refusal for r in got.collect()} == want and len(set(want.values())) == 5


def tables(spark):
    decisions = [("s1", "One", "confirmed", "monthly", 3, "recurring-v1"), ("s2", "Two", "confirmed", "weekly", None, "recurring-v1"), ("s3", "Three", "muted", "yearly", 1, "recurring-v0"), ("s4", "Four", "confirmed", "yearly", 1, "recurring-v0")]
    members = [("s1", 1), ("s1", 2), ("s1", 3), ("s2", 3), ("s2", 4), ("s3", 5), ("s4", 6)]
    return spark.createDataFrame(decisions, DECISIONS), spark.createDataFrame(members, "signature string, txn_id long")


def of(members, signature):
    return sorted(r.txn_id for r in members.filter(F.col("signature") == signature).collect())


def test_merge(spark):
    decisions, members = tables(spark)
    wanted = spark.createDataFrame([(1, " Both ", 2, "s1"), (1, " Both ", 1, "s2"), (2, "x", 1, "s3"), (3, "y", 1, "s3"), (3, "y", 2, "none")], "merge_id long, name string, ordinal int, signature string")
    d, m, bad = lifecycles.merged(decisions, members, wanted)
    assert {r.signature: (r.name, r.status, r.cadence, r.detector_version) for r in d.collect() if r.signature != "s4"} == {
        "s1": ("One", "superseded", "monthly", "recurring-v1"), "s2": ("Two", "superseded", "weekly", "recurring-v1"), "s3": ("Three", "muted", "yearly", "recurring-v0"), "merged:s1:s2": ("Both", "confirmed", "weekly", "user-merged-v1"),
    }
    assert of(m, "merged:s1:s2") == [1, 2, 3, 4] and of(m, "s1") == [1, 2, 3]
    assert sorted(map(tuple, bad.collect())) == [(2, "fewer than two series"), (3, "unknown series")]


def test_split(spark):
    decisions, members = tables(spark)
    rows = [("s1", 1, "A", 1), ("s1", 2, "B", 2), ("s1", 2, "B", 3), ("s2", 1, "x", 3), ("s2", 2, "x", 3), ("s3", 1, "x", 5), ("s9", 1, "x", 1), ("s9", 2, "x", 2), ("s4", 1, "x", 6), ("s4", 2, "x", 7)]
    d, m, bad = lifecycles.split(decisions, members, spark.createDataFrame(rows, "signature string, child int, name string, txn_id long"))
    got = {r.signature: (r.name, r.status, r.cadence, r.tolerance_days) for r in d.collect()}
    assert got["s1"][1] == "superseded" and got["split:s1:1"] == ("A", "confirmed", "monthly", 3) and got["split:s1:2"] == ("B", "confirmed", "monthly", 3) and len(got) == 6
    assert of(m, "split:s1:2") == [2, 3]
    assert sorted(map(tuple, bad.collect())) == [("s2", "no partition of the members"), ("s3", "fewer than two groups"), ("s4", "no partition of the members"), ("s9", "unknown series")]


def test_reconcile_and_void(spark):
    decisions, members = tables(spark)
    ledger = spark.createDataFrame([(i, "void" if i == 4 else "posted") for i in range(1, 7)], "txn_id long, status string")
    assert {r.signature: r.status for r in lifecycles.reconciled(decisions, members, ledger).collect()} == {"s1": "confirmed", "s2": "invalidated", "s3": "muted", "s4": "invalidated"}
    links = spark.createDataFrame([("x", "confirmed", 1, 9), ("y", "rejected", 1, 8), ("z", "confirmed", 8, 9)], "signature string, status string, outflow_id long, inflow_id long")
    events = lifecycles.void_events(spark.createDataFrame([(1,), (5,), (1,)], "txn_id long"), "e1", links, decisions, members)
    assert sorted(map(tuple, events.collect())) == [("e1:recurring:s1", "recurring", "s1", "invalidate-source", "confirmed", "invalidated"), ("e1:transfer:x", "transfer", "x", "invalidate-source", "confirmed", "unlinked")]
    assert {r.signature: r.status for r in lifecycles.applied(links, events, "transfer").collect()} == {"x": "unlinked", "y": "rejected", "z": "confirmed"}
    assert {r.signature: r.status for r in lifecycles.applied(decisions, events, "recurring").collect()}["s1"] == "invalidated"
