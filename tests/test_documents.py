"""Canonical documents, their checks, and digests."""

import hashlib
import json
import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from coinbrook.operators import documents

LEDGER = "txn_id string, account_id string, posted_date date, amount decimal(18,2), currency string, status string, review_state string, merchant_id string, category_id string, category_locked boolean, description string, notes string, tags array<string>"
ROWS = [
    ("t1", "a", date(2026, 7, 1), D("-5.10"), "CAD", "posted", "reviewed", None, "food", True, 'Café "x" \n', None, ["b", "a"]),
    ("t2", "a", date(2026, 7, 2), D("0.00"), "USD", "void", "unreviewed", "m1", None, False, "plain", "é", []),
]


NO_JSON = ['{"a":1,"a":2}', "[", None, "", "{}}", "1] [2", '1} {"y":2', "1,2", '1,"y":2', "nul", "{} {}"]


def test_canonical_json(spark):
    rnd = random.Random(1)

    def value(depth):
        kind = rnd.randrange(7 if depth else 5)
        return [None, True, rnd.randrange(-9, 99), 1.5, rnd.choice(["é\n", "", 'q"'])][kind] if kind < 5 else [value(depth - 1) for _ in range(3)] if kind == 5 else {rnd.choice("zyxwab") + str(i): value(depth - 1) for i in range(rnd.randrange(4))}

    many = [value(4) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3)) for i, v in enumerate(many)] + [(-i, j) for i, j in enumerate(NO_JSON, 1)], "i int, j string")
    got = {r.i: r.c for r in df.select("i", documents.canonical(F.col("j")).alias("c")).collect()}
    assert all(got[i] == json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for i, v in enumerate(many))
    assert [got[-i] for i in range(1, len(NO_JSON) + 1)] == [None] * len(NO_JSON)


def test_round_trip(spark):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    docs = documents.transaction_documents(ledger)
    body = json.loads(docs.filter("txn_id = 't1'").first().document)
    assert body["schemaVersion"] == "1.0.0" and body["amount"] == "-5.1" and "notes" not in body and body["tags"] == ["b", "a"] and body["classifications"] == {"category": {"locked": True, "value": "food"}}
    assert list(body) == sorted(body)
    back = documents.decoded(docs.select("document")).select("problem", *[F.col(c).cast(t).alias(c) for c, t in ledger.dtypes])
    assert sorted(back.collect()) == sorted((None, *r) for r in ROWS)


def test_refused_documents(spark):
    good = json.loads(documents.transaction_documents(spark.createDataFrame(ROWS[:1], LEDGER)).first().document)
    edits = {
        "": {}, "unsupported version": {"schemaVersion": "2.0.0"}, "missing amount": {"amount": None}, "invalid amount": {"amount": "1e3"}, "invalid date": {"postedDate": "2026-02-30"}, "invalid currency": {"currency": "cad"},
        "invalid status": {"status": "open"}, "invalid review state": {"reviewState": "x"}, "invalid description": {"description": "  "}, "invalid tags": {"tags": ["a", "a"]},
    }
    rows = [(k, json.dumps(good | v)) for k, v in edits.items()] + [("no JSON", "{"), ("no object", "[1]"), ("no JSON", None)]
    got = documents.decoded(spark.createDataFrame(rows, "want string, document string")).collect()
    assert [r.problem or "" for r in got] == [w for w, _ in rows] and all((r.txn_id is None) == bool(r.want) for r in got)


def test_key_paths(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[{"c":1},{"c":2,"secrets":0}]},"d":3}'), (2, "[[{}],4]"), (3, "no")], "i int, j string")
    assert sorted((r.i, r.path, r.depth) for r in documents.key_paths(df, "i", "j").collect()) == [(1, "/a", 1), (1, "/a/b", 2), (1, "/a/b[]/c", 4), (1, "/a/b[]/c", 4), (1, "/a/b[]/secrets", 4), (1, "/d", 1)]
    assert documents.key_paths(df.limit(0), "i", "j").count() == 0


def test_brain_problems(spark, monkeypatch):
    monkeypatch.setattr(documents, "MAX_BRAIN_BYTES", 600)
    base = {"schemaVersion": "1.0.0", "brainId": "b", "createdAt": "t", "updatedAt": "t", "categories": [{"id": "c1", "name": "x"}, {"id": "c2", "parentId": "c1"}], "merchants": [{"id": "m1"}, {"id": "m2", "redirectToId": "m1"}], "rules": [], "recurringDecisions": []}
    cases = {
        "fine": (base, []), "large": (base | {"x": "y" * 600}, [(1, "too large")]), "array": ([1], [(2, "no object")]), "secret": (base | {"secrets": 1, "balances": 2, "categories": None}, [(3, "prohibited balances"), (3, "prohibited secrets")]),
        "keys": ({k: v for k, v in base.items() if k != "rules"} | {"schemaVersion": "9"}, [(4, "missing rules"), (4, "unsupported version")]),
        "ids": (base | {"categories": [{"id": "c"}, {"id": "c"}], "merchants": [{"id": "m", "redirectToId": "zz"}]}, [(5, "repeated id in categories: c")]),
        "links": (base | {"categories": [{"id": "c", "parentId": "q"}], "merchants": [{"id": "m", "redirectToId": "zz"}]}, [(6, "no parentId q"), (6, "no redirectToId zz")]),
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("broken", "{")], "name string, body string")
    got = sorted((r.name, r.step, r.problem) for r in documents.brain_problems(df, "name", "body").collect())
    assert got == sorted([(k, *p) for k, (_, ps) in cases.items() for p in ps] + [("broken", 2, "no JSON")])


def test_digest_of_rows(spark):
    def tree(values):
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        items = {}
        for d in map(h, values):
            items.setdefault(d[:6], {}).setdefault(d, []).append(1)
        leaves = {leaf: h(",".join(sorted(f"{d}:{len(n)}" for d, n in own.items()))) for leaf, own in items.items()}
        branches = {b: h(",".join(sorted(f"{x}:{d}" for x, d in leaves.items() if x[:3] == b))) for b in {x[:3] for x in leaves}}
        return len(leaves), h(",".join(sorted(f"{b}:{d}" for b, d in branches.items())))

    values = [f"t:{i % 400}:x" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    digest = lambda df: tuple(documents.revision(df, F.col("v")).first())
    assert digest(df) == digest(df.repartition(7).orderBy(F.desc("v"))) == tree(values)
    for edited in (values[1:], [*values, "t:0:x"], ["t:0:y", *values[1:]]):
        changed = spark.createDataFrame([(v,) for v in edited], "v string")
        assert digest(changed) == tree(edited) != digest(df)
        assert 1 <= documents.changed_leaves(documents.leaves(df, F.col("v")), documents.leaves(changed, F.col("v"))).count() <= 2
    assert digest(df.limit(0)) == tree([])
