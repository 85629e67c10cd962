"""Drafts, commits, evaluations and projections on small tables: nulls, empty tables, ties."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from coinbrook.operators import duplicates, knowledge
from coinbrook.sources import mapping

DRAFT = "posted_date string, transaction_date string, description string, amount string, currency string, source_id string"
CANDIDATE = "sha256 string, account_id string, currency string, parser_id string, parser_version string, source_id string"
SOURCE = "sha256 string, parser_id string, parser_version string, source_rows long, n_errors long"


def test_drafts(spark):
    rows = [
        ("2026-01-02", None, "a", "-0.00", "USD", None),
        ("2026-01-02", "", "\U0001f600" * 500, "12345678901234567890.10", "USD", "x" * 240),
        ("2026-01-02", "2026-1-2", "\U0001f600" * 501, ".10", "USD", "\U0001f600" * 121),
        (None, None, None, None, None, None),
    ]
    checked = mapping.checked_drafts(spark.createDataFrame(rows, DRAFT), "USD")
    assert [r.bad for r in checked.collect()] == [[], [], ["transaction_date", "description", "amount", "source_id"], ["posted_date", "description", "amount", "currency"]]
    assert mapping.draft_totals(checked).collect() == [(D("12345678901234567890.10"), D("0.00"), 2, 2, False)]
    assert mapping.draft_totals(checked.limit(0)).collect() == [(D("0.00"), D("0.00"), 0, 0, True)]
    with pytest.raises(ValueError, match="currency"):
        mapping.checked_drafts(checked, "usd")


def test_commit(spark):
    good = [("h", "a", "USD", "csv", "1", "i1"), ("h", "a", "USD", "csv", "1", None), ("h", "a", "USD", "csv", "1", None)]
    problems = lambda c, s: sorted((r.problem, r.subject, r.n) for r in mapping.commit_problems(spark.createDataFrame(c, CANDIDATE), spark.createDataFrame(s, SOURCE), "a", "USD").collect())
    assert problems(good, [("h", "csv", "1", 3, 0)]) == []
    assert problems([], []) == [("no source", None, 0)]
    assert problems(good, []) == [("no source", None, 0), ("source not selected", "h", 3)]
    assert problems([], [("h", "csv", "1", 0, None)]) == []
    assert problems([("h", None, "EUR", None, "1", "i"), ("h", "a", "USD", "csv", "1", "i")], [("h", "csv", "1", None, 2)]) == [
        ("identifier twice", "i", 2), ("other account", None, 1), ("other currency", None, 1), ("other parser", "h", 1), ("rows are not candidates one to one", "h", 2), ("source with errors", "h", 2),
    ]


def test_evaluation(spark):
    schema = "run string, case_id string, kind string, correct boolean, grounding_violation boolean, privacy_violation boolean, latency_ms long"
    rows = [("a", "1", "answered", True, None, None, 10), ("a", "2", "abstained", False, None, None, 30), ("a", "3", "invalidOutput", None, None, None, 20), ("a", "no case", "answered", True, True, None, 40), ("b", "1", "answered", True, None, None, 2001)]
    cases = spark.createDataFrame([("a", "1", False), ("a", "2", True), ("a", "2", True), ("a", "9", True), ("c", "1", True)], "run string, case_id string, expected_abstention boolean")
    outcomes = spark.createDataFrame(rows, schema)
    m = {r.run: r for r in knowledge.evaluation(outcomes, cases).collect()}
    a = m["a"]
    assert set(m) == {"a", "b"} and (a.total, a.answerable, a.should_abstain, a.did_abstain, a.accuracy, a.abstention_precision, a.abstention_recall, a.invalid_rate, a.grounding_violations, a.latency_median, a.latency_p95) == (4, 3, 2, 1, 2 / 3, 1.0, 0.5, 0.25, 1, 30, 40)
    gates = {r.run: (r.status, r.failures) for r in knowledge.evaluation_gates(knowledge.evaluation(outcomes, cases)).collect()}
    assert gates == {"a": ("failed", ["grounding_violations", "invalid_rate"]), "b": ("experimental", ["abstention_recall", "latency_p95"])}
    assert knowledge.evaluation_gates(knowledge.evaluation(outcomes.limit(0), cases)).count() == 0


def test_projection_of_decisions(spark):
    """A row that one decision voids and another keeps is void; rows of decisions are reviewed; others are as they were."""
    found = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "existing_id string, incoming_id string").selectExpr("concat(existing_id, ':', incoming_id) AS candidate_id", "*", "'likely' AS kind", "5000 AS score", "0 AS days", "1.0D AS similarity")
    signed = duplicates.evidence_signature(found).select("candidate_id", "evidence_signature")
    events = spark.createDataFrame([("decision", "e1", "a:b", "keep-existing", None), ("decision", "e2", "b:c", "keep-both", None), ("decision", "e3", "d:e", "keep-new", None), ("undo", "u", None, None, "e3")], "type string, event_id string, candidate_id string, action string, decision_id string").join(signed, "candidate_id", "left")
    ledger = spark.createDataFrame([(x, "posted", "unreviewed", 1) for x in "abcde"] + [(None, "posted", None, 1)], "txn_id string, status string, review_state string, decided_id int")
    got = duplicates.project(ledger.drop("decided_id"), found, events)
    assert {tuple(r) for r in got.collect()} == {("a", "posted", "reviewed"), ("b", "void", "reviewed"), ("c", "posted", "reviewed"), ("d", "posted", "unreviewed"), ("e", "posted", "unreviewed"), (None, "posted", None)}


def test_eligible_rows(spark):
    rows = [(1, "posted", "x", None, None), (2, "void", "y", None, None), (3, "posted", "y", True, None), (4, "posted", "y", None, True), (5, "posted", None, None, False), (6, "posted", "z", False, None)]
    queue = spark.createDataFrame(rows, "txn_id long, status string, normalized string, category_locked boolean, merchant_locked boolean")
    rejected = spark.createDataFrame([("x", "1"), ("z", "2"), ("x", "1"), (None, "1")], "normalized string, classifier_version string")
    assert [r.txn_id for r in knowledge.queue_eligible(queue, rejected, "1").orderBy("txn_id").collect()] == [5, 6]
    assert [r.txn_id for r in knowledge.queue_eligible(queue, rejected, "1", limit=1).collect()] == [5]
    assert knowledge.suggestion_members(queue.select("txn_id", "normalized", F.lit(D(0)).alias("amount"), F.lit(None).alias("updated_at"))).select("direction").distinct().collect() == [("inflow",)]
