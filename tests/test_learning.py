"""Review corrections: applied as one, journaled, undone, refused."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest

from coinbrook.operators import learning
from coinbrook.operators.ledger import Edit
from coinbrook.streaming import snapshots
from coinbrook.streaming.snapshots import Change, RevisionConflict

LEDGER = "txn_id long, posted_date date, amount decimal(18,2), category_id string, category_locked boolean, merchant_id string, merchant_locked boolean, notes string, tags array<string>, review_state string"
NOW = datetime(2026, 7, 1)


@pytest.fixture
def workspace(spark, tmp_path):
    path = str(tmp_path / "ws")
    row = lambda i: (i, date(2026, 7, i), D(f"-{i}.50"), None, False, None, False, None, ["a"], "needsReview")
    tables = {
        "transactions": spark.createDataFrame([row(i) for i in range(1, 6)], LEDGER),
        "rules": spark.createDataFrame([("r1", "old", 5, [("tag", "equals", "a", None, None), ("direction", "equals", "outflow", None, None)], None, "food", True)], learning.RULES),
        "aliases": spark.createDataFrame([("a1", "m1", "shop", "exact")], "alias_id string, merchant_id string, pattern string, match_mode string"),
        "merchants": spark.createDataFrame([("m1",), ("m2",)], "merchant_id string"),
    }
    snapshots.commit(spark, path, snapshots.Snapshot(), {n: Change(t) for n, t in tables.items()})
    return path


def contents(spark, path, at=None):
    return {n: sorted(map(str, t.select(*sorted(t.columns)).collect())) for n, t in snapshots.read(spark, path, at).items() if n != learning.JOURNAL}


def ids(spark, *some):
    return spark.createDataFrame([(i,) for i in some], "txn_id long")


def correct(spark, path, op="o1", some=(1, 2), category="dining", **more):
    return learning.correct(spark, path, op, ids(spark, *some), Edit(category_id=category, review_state="reviewed"), NOW, **more)


RULE = learning.NewRule("r2", "new", (("normalizedDescription", "startsWith", "shop"),), 7, set_category="dining")
ALIAS = learning.NewAlias("a2", "m2", "Corner SHOP", "contains")


def test_one_operation_over_three_stores_and_back(spark, workspace):
    before = contents(spark, workspace)
    at = correct(spark, workspace, rule=RULE, alias=ALIAS)
    assert at.number == 2  # one revision
    now = snapshots.read(spark, workspace)
    assert {r.txn_id: (r.category_id, r.category_locked, r.review_state, r.amount, r.tags) for r in now["transactions"].collect()} == {
        i: ("dining", True, "reviewed", D(f"-{i}.50"), ["a"]) if i < 3 else (None, False, "needsReview", D(f"-{i}.50"), ["a"]) for i in range(1, 6)
    }
    assert {r.rule_id: (r.priority, r.set_category, [c.value for c in r.conditions]) for r in now["rules"].collect()}["r2"] == (7, "dining", ["shop"])
    assert sorted((r.alias_id, r.pattern) for r in now["aliases"].collect()) == [("a1", "shop"), ("a2", "corner shop")]
    assert [(r.operation_id, r.kind, r.n_changes, r.undone_at) for r in learning.history(spark, workspace, at).collect()] == [("o1", "review-correction", 4, None)]
    at = learning.undo(spark, workspace, "o1", NOW, at)
    assert at.number == 3 and contents(spark, workspace) == before
    assert learning.history(spark, workspace, at).first().undone_at == NOW
    with pytest.raises(learning.CorrectionRefused):
        learning.undo(spark, workspace, "o1", NOW, at)


def test_operations_are_undone_in_reverse_order(spark, workspace):
    start = contents(spark, workspace)
    correct(spark, workspace, "o1", (1, 2), "dining")
    middle = contents(spark, workspace)
    at = correct(spark, workspace, "o2", (2, 3), "food")
    # The later operation changed row 2 again: the earlier one's image no longer holds.
    with pytest.raises(RevisionConflict):
        learning.undo(spark, workspace, "o1", NOW, at)
    assert snapshots.newest(spark, workspace) == at
    at = learning.undo(spark, workspace, "o2", NOW, at)
    assert contents(spark, workspace) == middle
    learning.undo(spark, workspace, "o1", NOW, at)
    assert contents(spark, workspace) == start


@pytest.mark.parametrize(
    "more",
    [
        {"some": ()},
        {"some": (77,)},
        {"rule": learning.NewRule("r1", "id is taken", (("tag", "equals", "z"),), set_category="x")},
        {"rule": learning.NewRule("r3", "conflict", (("direction", "equals", "outflow"), ("tag", "equals", "a")), 5, set_category="other")},
        {"alias": learning.NewAlias("a3", "m9", "no such merchant")},
        {"alias": learning.NewAlias("a3", "m1", "***")},
    ],
)
def test_refusals_write_nothing(spark, workspace, more):
    before = contents(spark, workspace)
    with pytest.raises(learning.CorrectionRefused):
        correct(spark, workspace, **more)
    assert contents(spark, workspace) == before and snapshots.newest(spark, workspace).number == 1


def test_agreeing_rule_and_known_alias(spark, workspace):
    same = learning.NewRule("r4", "agrees", (("tag", "equals", "a"), ("direction", "equals", "outflow")), 5, set_category="food")
    correct(spark, workspace, rule=same, alias=learning.NewAlias("a4", "m1", "Shop", "exact"))
    now = snapshots.read(spark, workspace)
    assert now["rules"].count() == 2 and now["aliases"].count() == 1


def test_stale_revision_and_known_operation(spark, workspace):
    old = snapshots.newest(spark, workspace)
    correct(spark, workspace)
    with pytest.raises(RevisionConflict):
        correct(spark, workspace, "o2", (4,), at=old)
    with pytest.raises(learning.CorrectionRefused):
        correct(spark, workspace, "o1", (4,))
    with pytest.raises(learning.CorrectionRefused):
        learning.undo(spark, workspace, "none", NOW, snapshots.newest(spark, workspace))
