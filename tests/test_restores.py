"""Restores in three modes, and suggestions held against what has changed."""

import pytest

from coinbrook.operators import knowledge
from coinbrook.streaming import restores, snapshots
from coinbrook.streaming.snapshots import Change

KEYS = {"a": "id", "b": "id"}


def rows(spark, *some):
    return spark.createDataFrame(list(some), "id long, v string")


def content(spark, path):
    return {n: sorted(map(tuple, t.collect())) for n, t in snapshots.read(spark, path).items()}


@pytest.fixture
def made(spark, tmp_path):
    path = str(tmp_path / "ws")
    at = snapshots.commit(spark, path, snapshots.Snapshot(), {"a": Change(rows(spark, (1, "x"), (2, "y"))), "c": Change(rows(spark, (9, "z")))})
    return path, at, {"a": rows(spark, (2, "other"), (3, "new")), "b": rows(spark, (5, "b"))}


def test_modes(spark, made, tmp_path):
    path, at, backup = made
    assert [tuple(r) for r in restores.conflicts(snapshots.read(spark, path, at), backup, KEYS).collect()] == [("a", "2")]
    at = restores.restore(spark, path, at, backup, KEYS, "merge")
    assert content(spark, path) == {"a": [(1, "x"), (2, "y"), (3, "new")], "b": [(5, "b")], "c": [(9, "z")]}
    with pytest.raises(restores.RestoreRefused):
        restores.restore(spark, path, at, backup, KEYS, "new")
    restores.restore(spark, path, at, backup, KEYS, "replace")
    whole = {"a": [(2, "other"), (3, "new")], "b": [(5, "b")]}
    assert content(spark, path) == whole
    other = str(tmp_path / "other")
    restores.restore(spark, other, snapshots.Snapshot(), backup, KEYS, "new")
    assert content(spark, other) == whole
    with pytest.raises(ValueError):
        restores.restore(spark, other, snapshots.newest(spark, other), backup, KEYS, "some")


def test_manifest_is_checked_first(spark, made):
    path, at, backup = made
    good = knowledge.manifest(backup)
    with pytest.raises(restores.RestoreRefused):
        restores.restore(spark, path, at, backup | {"a": rows(spark, (2, "edited"), (3, "new"))}, KEYS, "replace", good)
    assert snapshots.newest(spark, path) == at
    assert restores.restore(spark, path, at, backup, KEYS, "replace", good).number == 2


def test_suggestions(spark):
    ledger = spark.createDataFrame([(i, 10, i == 4, False) for i in range(1, 9)], "txn_id long, updated_at long, category_locked boolean, merchant_locked boolean")
    queue = spark.createDataFrame([(i,) for i in range(1, 9) if i != 3], "txn_id long")
    s = lambda i, status="pending", kind="category", txn=1, at=10: (i, status, kind, txn, at, "food")
    known = [s(1), s(2, "accepted"), s(3, kind="abstain"), s(4, at=9), s(5, txn=3), s(6, txn=4), s(7, kind="merchant", txn=5), s(8, kind="merchant", txn=6), s(9, txn=99)]
    suggestions = spark.createDataFrame(known, "suggestion_id long, status string, kind string, txn_id long, updated_at long, category_id string")
    wanted = spark.createDataFrame([(i, "m1" if i == 8 else None) for i in range(1, 11)], "suggestion_id long, merchant_id string")
    got = {r.suggestion_id: (r.problem, r.new_status, r.category_id, r.merchant_id) for r in restores.judged_suggestions(wanted, suggestions, ledger, queue).collect()}
    assert got == {
        1: (None, "accepted", "food", None), 2: ("is accepted", "accepted", None, None), 3: ("abstention", "pending", None, None), 4: ("changed", "stale", None, None), 5: ("resolved", "stale", None, None),
        6: ("resolved", "stale", None, None), 7: ("no merchant", "pending", None, None), 8: (None, "accepted", None, "m1"), 9: ("changed", "stale", None, None), 10: ("not found", None, None, None),
    }
