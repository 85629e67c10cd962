"""Several tables under one revision: readers, writers, interleavings, upserts."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from coinbrook.streaming import ingest, snapshots
from coinbrook.streaming.snapshots import Change, RevisionConflict


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.fixture
def two(spark, tmp_path):
    path = str(tmp_path / "ws")
    at = snapshots.create(spark, path, " Home ")
    return path, snapshots.commit(spark, path, at, {"a": Change(spark.range(3)), "b": Change(spark.range(10, 12))})


def test_reader_sees_all_tables_of_a_commit_or_none(spark, two, monkeypatch):
    path, before = two
    seen, publish = [], snapshots._publish

    def watched(*args):
        seen.append({n: ids(t) for n, t in snapshots.read(spark, path).items()})
        publish(*args)
        seen.append({n: ids(t) for n, t in snapshots.read(spark, path).items()})

    monkeypatch.setattr(snapshots, "_publish", watched)
    held = snapshots.read(spark, path, before)
    snapshots.commit(spark, path, before, {"a": Change(spark.range(3, 5)), "b": snapshots.replaced(spark.range(20, 21))})
    assert seen == [{"a": [0, 1, 2], "b": [10, 11]}, {"a": [0, 1, 2, 3, 4], "b": [20]}]
    # What was read before stays as it was, and a revision can be read again by its number.
    assert ids(held["a"]) == [0, 1, 2] and ids(held["b"]) == [10, 11]
    assert snapshots.at_revision(spark, path, 2) == before and before.name == "Home"


def test_stale_writer_changes_nothing(spark, two, monkeypatch):
    path, before = two
    snapshots.commit(spark, path, before, {"a": Change(spark.range(7, 8))})
    with pytest.raises(RevisionConflict):
        snapshots.commit(spark, path, before, {"b": Change(spark.range(1))})
    # Both saw one revision, and the other was first to publish.
    with pytest.raises(RevisionConflict):
        snapshots._publish(spark, path, snapshots.Snapshot(3))
    now = snapshots.read(spark, path)
    assert ids(now["a"]) == [0, 1, 2, 7] and ids(now["b"]) == [10, 11]
    # A writer that breaks off after its folders leaves no trace that is read.
    monkeypatch.setattr(snapshots, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        snapshots.commit(spark, path, snapshots.newest(spark, path), {"a": Change(spark.range(50, 51)), "b": Change(spark.range(50, 51))})
    assert ids(snapshots.read(spark, path)["a"]) == [0, 1, 2, 7] and snapshots.newest(spark, path).number == 3


def test_overtaken_writer_tries_again(spark, two):
    path, _ = two
    calls = []

    def change(at):
        calls.append(at.number)
        if len(calls) == 1:  # another writer comes in between
            snapshots.commit(spark, path, at, {"b": Change(spark.range(99, 100))})
        return snapshots.commit(spark, path, at, {"a": Change(spark.range(at.number, at.number + 1))})

    assert snapshots.retried(spark, path, change).number == 4 and calls == [2, 3]
    assert ids(snapshots.read(spark, path)["b"]) == [10, 11, 99]


def test_upsert_writes_only_folders_with_a_key(spark, tmp_path):
    path = str(tmp_path / "ws")
    rows = spark.range(40).withColumns({"v": (F.col("id") * 2).cast("decimal(18,2)"), "tag": F.lit(None).cast("string")})
    at = snapshots.Snapshot()
    for part in snapshots.bucketed(rows, "id", 4):
        at = snapshots.commit(spark, path, at, {"t": Change(part)})
    images = spark.createDataFrame([(3, (D("1.00"), "x")), (100, (D("2.00"), "new")), (5, None)], "id long, after struct<v: decimal(18,2), tag: string>")
    change = snapshots.upserted(spark, path, at, "t", "id", images)
    new = snapshots.commit(spark, path, at, {"t": change})
    assert 1 <= len(change.drop) <= 2 and set(at.tables["t"]) - set(change.drop) == set(at.tables["t"]) & set(new.tables["t"])
    got = {r.id: (r.v, r.tag) for r in snapshots.table(spark, path, new, "t").collect()}
    assert got == {i: (D(2 * i), None) for i in range(40) if i != 5} | {3: (D(1), "x"), 100: (D(2), "new")}
    assert snapshots.upserted(spark, path, new, "t", "id", images.filter("id = 7777")).drop == ()


def test_numbers_and_names(spark, tmp_path):
    assert snapshots.next_number(0) == 1 and snapshots.next_number(snapshots.LAST_REVISION - 1) == snapshots.LAST_REVISION
    for bad in (snapshots.LAST_REVISION, -1):
        with pytest.raises(ValueError):
            snapshots.next_number(bad)
    for name in ("  ", "x" * 121):
        with pytest.raises(ValueError):
            snapshots.create(spark, str(tmp_path / "n"), name)
    assert snapshots.newest(spark, str(tmp_path / "n")) == snapshots.Snapshot() and snapshots.read(spark, str(tmp_path / "n")) == {}


def test_rows_of_one_batch_meet_each_other(spark, tmp_path):
    schema = "txn_id string, account_id string, posted_date date, amount decimal(18,2), currency string, description string, status string, review_state string, source_id string"
    row = lambda n, day, text="Blue Bottle": (f"t{n}", "a", date(2026, 7, day), D("-5.00"), "CAD", text, "posted", "reviewed", None)
    path = str(tmp_path / "ws")
    ingest.take(spark, path, "s", spark.createDataFrame([row(1, 1), row(2, 1), row(3, 20), row(4, 1, "Other words")], schema), 0)
    assert {r.txn_id: r.review_state for r in ingest.load(spark, path).collect()} == {"t1": "reviewed", "t2": "needsReview", "t3": "reviewed", "t4": "reviewed"}
    # The same batch again, after a failure, changes nothing.
    assert ingest.take(spark, path, "s", spark.createDataFrame([row(9, 9)], schema), 0).number == 1 and ingest.load(spark, path).count() == 4
