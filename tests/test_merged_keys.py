"""Merges of many series: the long new signature stands in one row, not in one for each member."""

from collections import Counter

from pyspark.sql import functions as F

from coinbrook.operators import lifecycles, recurring
from coinbrook.plans import ledgers as L
from coinbrook.plans import registry

DECISIONS = "signature string, name string, status string, cadence string, tolerance_days int, detector_version string"


def written(spark):
    """Bytes of shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_many_series_in_one_merge(spark, tmp_path):
    import duckdb

    spark.range(1500).select(F.col("id").alias("p_partkey"), F.concat(F.lit("same "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 30)).alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    day = lambda n: F.date_add(F.lit("1995-01-01").cast("date"), n)
    spark.range(6000).select(
        (F.col("id") % 1500).alias("l_partkey"), day((91 * F.floor(F.col("id") / 1500)).cast("int")).cast("timestamp").alias("l_shipdate"), (F.col("id") % 90 + 1).cast("double").alias("l_extendedprice"), F.lit("F").alias("l_linestatus"), F.lit(1).alias("l_linenumber")
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = written(spark)
    got = registry.queries()["recurring_merged"](spark, str(tmp_path)).select("signature", "status", "cadence", "n_members").collect()
    assert written(spark) - before < 8_000_000
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(registry.oracle_sql()["recurring_merged"])
    assert len(got) == 1501 and Counter(map(tuple, got)) == Counter(map(tuple, rel.select("signature, status, cadence, n_members").fetchall()))


def test_keys_equal_whole_signatures(spark):
    decisions = spark.createDataFrame([(f"s{i}", f"n{i}", "confirmed", "weekly", 1, "recurring-v1") for i in range(5)], DECISIONS)
    members = spark.createDataFrame([(f"s{i}", (i + j) % 6) for i in range(5) for j in range(3)], "signature string, txn_id long")
    wanted = spark.createDataFrame([(1, "a", 1, "s0"), (1, "a", 2, "s1"), (2, "b", 1, "s1"), (2, "b", 2, "s0"), (3, "c", 1, "s1"), (3, "c", 2, "s3"), (3, "c", 3, "s3"), (4, "d", 1, "s4")], "merge_id long, name string, ordinal int, signature string")
    d, m, bad = lifecycles.merged(decisions, members, wanted)
    own = lambda *ids: sorted({(i + j) % 6 for i in ids for j in range(3)})
    rows = {}
    for r in m.collect():
        rows.setdefault(r.signature, []).append(r.txn_id)
    assert {k: sorted(v) for k, v in rows.items()} == {f"s{i}": own(i) for i in range(5)} | {"merged:s0:s1": own(0, 1), "merged:s1:s3": own(1, 3)}
    assert {r.signature: r.status for r in d.collect()} == {"s0": "superseded", "s1": "superseded", "s2": "confirmed", "s3": "superseded", "s4": "confirmed", "merged:s0:s1": "confirmed", "merged:s1:s3": "confirmed"}
    assert [tuple(r) for r in bad.collect()] == [(4, "fewer than two series")]
    added, parts, _ = lifecycles.merges(decisions, wanted)
    keys = {r.key: r.signature for r in added.collect()}
    assert Counter((keys[r.key], r.txn_id) for r in lifecycles.merged_members(members, parts).collect()) == Counter((s, t) for s, ts in rows.items() if s.startswith("merged:") for t in ts)


def test_found_is_proposals_without_amounts(spark, sf):
    rows = L.items(spark, sf)
    found = recurring.found(rows)
    want = recurring.proposals(rows).select(*found.columns)
    assert found.count() > 0 and sorted(found.collect()) == sorted(want.collect())
