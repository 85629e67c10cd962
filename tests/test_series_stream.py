"""Series as transactions arrive, and medians of large series."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from coinbrook.operators import recurring
from coinbrook.streaming import series, snapshots

SCHEMA = "txn_id long, posted_date date, amount decimal(18,2), currency string, status string, description string"


def generated(seed, n):
    rnd = random.Random(seed)
    row = lambda i: (i, date(2026, 1, 1) + timedelta(rnd.choice([7, 30]) * rnd.randrange(12)), D(rnd.randrange(-900, 100)) / 100, rnd.choice(["CAD", "USD"]), rnd.choice(["posted", "posted", "void"]), f"Plan {rnd.choice('abcdefgh')} {rnd.randrange(99)}")
    return [row(i) for i in range(n)]


def test_state_equals_full_detection_after_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(series, "PARTS", 2)
    path, rows, seen, ever = str(tmp_path / "ws"), generated(5, 160), [], set()
    for batch, end in enumerate((6, 40, 41, 160)):
        part = rows[len(seen) : end]
        seen += part
        series.take(spark, path, "s", spark.createDataFrame(part, SCHEMA), batch)
        if batch == 1:  # run again after a failure
            assert series.take(spark, path, "s", spark.createDataFrame(part, SCHEMA), batch).number == 2
        want = recurring.proposals(spark.createDataFrame(seen, SCHEMA))
        got = series.proposals(spark, path).select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        ever |= {r.signature for r in got.collect()}
    assert len(ever) >= 8
    at = snapshots.newest(spark, path)
    assert at.number == 4 and len(at.tables[series.TOTALS]) <= 3


def test_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ws")
    rows = generated(6, 120)
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        series.start(spark.readStream.schema(SCHEMA).parquet(source), path, str(tmp_path / "cp")).awaitTermination()
    want = recurring.proposals(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, series.proposals(spark, path).select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_large_groups_are_dealt_to_bins(spark, monkeypatch):
    monkeypatch.setattr(recurring, "LARGE", 20)
    rnd = random.Random(2)
    groups = defaultdict(list)
    for i in range(900):
        g = rnd.choice(["one value", "skewed", "even", f"small {i % 40}"])
        groups[g].append({"one value": D("5.00"), "skewed": D(rnd.choice([1, 2, 3, 10**9]))}.get(g, D(rnd.randrange(99999)) / 100))
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v decimal(18,2)")
    got = {r.g: r.median for r in recurring.upper_medians(df, ["g"], "v").collect()}
    assert got == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}


def test_a_million_amounts_spread_over_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1_000_003).cast("decimal(18,2)").alias("v"))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("c")).withColumns({"members": F.lit(1_000_000), "least": F.lit(0).cast("decimal(18,2)"), "most": F.lit(1_000_002).cast("decimal(18,2)")})
    got = recurring.medians_of(counts.filter, ["g"], "v")
    assert got.collect()[0].median == sorted(i * 7919 % 1_000_003 for i in range(1_000_000))[500_000]
    # The one bin that is sorted holds about a thousandth of the values.
    assert 1_000_000 / recurring.BINS < 1000
