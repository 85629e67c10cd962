"""Recurring series kept up to date as transactions arrive.

The state is three tables of a workspace: totals of each series and counts of its amounts, as
parts that add up (a part a batch), and the proposals. A batch is summed by series; only the
series it touches are merged with their parts and detected anew, and their proposals replace
the old ones. Parts, proposals and the batch's number are one commit, so that a batch run
again changes nothing. When there are more than PARTS parts, the commit merges them.

Transactions are only added: least and most can't be taken back. Where known transactions
change, ``recurring.recompute`` detects their series from the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.functions import money
from coinbrook.operators import recurring
from coinbrook.streaming import snapshots
from coinbrook.streaming.snapshots import Change, Snapshot

TOTALS, AMOUNTS, PROPOSALS = "series_totals", "series_amounts", "series_proposals"
PARTS = 32
KEY = ["name", "currency"]


def merged_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(F.sum("members").cast("long").alias("members"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("least").cast(money.TOTAL).alias("least"), F.max("most").cast(money.TOTAL).alias("most"))


def merged_amounts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY, "size").agg(F.sum("c").cast("long").alias("c"))


def detected(totals: DataFrame, amounts: DataFrame) -> DataFrame:
    """Proposals from merged totals and counts of amounts."""
    series = recurring.regular(totals)
    sizes = series.select(*KEY, "members", "least", "most")
    return recurring.described(series, recurring.medians_of(lambda some: amounts.join(sizes.filter(some), KEY), KEY, "size"))


def _series_id(df: DataFrame) -> DataFrame:
    return df.withColumn("series_id", F.concat_ws("\x00", *KEY))


def take(spark: SparkSession, path: str, stream: str, batch: DataFrame, batch_id: int) -> Snapshot:
    """Commits one batch of transactions, unless it has been taken."""

    def change(at: Snapshot) -> Snapshot:
        if at.taken.get(stream, -1) >= batch_id:
            return at
        rows = recurring.eligible(batch).withColumn("size", F.abs("amount"))
        new = {TOTALS: recurring.totals(rows), AMOUNTS: rows.groupBy(*KEY, "size").agg(F.count("*").alias("c"))}
        touched = new[TOTALS].select(*KEY)
        whole = {}
        for name, merge in ((TOTALS, merged_totals), (AMOUNTS, merged_amounts)):
            old = snapshots.table(spark, path, at, name)
            own = new[name] if old is None else old.join(touched, KEY, "left_semi").unionByName(new[name])
            whole[name] = merge(own)
            if old is not None and len(at.tables[name]) >= PARTS:
                new[name] = snapshots.replaced(merge(old.unionByName(new[name])))
            else:
                new[name] = Change(new[name])
        found = _series_id(detected(whole[TOTALS], whole[AMOUNTS]))
        columns = [c for c in found.columns if c != "series_id"]
        after = found.select("series_id", F.struct(*columns).alias("after"))
        # A series that is touched and no longer regular loses its proposal.
        images = _series_id(touched).select("series_id").join(after, "series_id", "left")
        return snapshots.commit(spark, path, at, new | {PROPOSALS: snapshots.upserted(spark, path, at, PROPOSALS, "series_id", images)}, taken=(stream, batch_id))

    return snapshots.retried(spark, path, change)


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """The proposals as of the newest revision."""
    return snapshots.table(spark, path, snapshots.newest(spark, path), PROPOSALS).drop("series_id")


def start(rows: DataFrame, path: str, checkpoint: str):
    """Keeps the series of a stream of transactions; all that is there is taken, then the query ends."""
    return rows.writeStream.foreachBatch(lambda batch, batch_id: take(batch.sparkSession, path, checkpoint, batch, batch_id) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
