"""Incremental ingest: files that arrive are taken once, and each batch adds only its own rows.

A batch becomes one commit of three tables of a workspace (snapshots.py): its fresh
transactions, their fingerprints, and a line about the batch. A batch that is run again
finds itself among those taken, whatever other streams have written in between; one whose
revision is overtaken by another writer is held against the newer ledger and tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.operators import duplicates
from coinbrook.streaming import snapshots

LEDGER, PRINTS, IMPORTS = "transactions", "fingerprints", "imports"


def revision(spark: SparkSession, path: str) -> int:
    return snapshots.newest(spark, path).number


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's rows as of its newest revision; None before the first."""
    return snapshots.table(spark, path, snapshots.newest(spark, path), LEDGER)


def fresh_rows(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose id the ledger does not have. Those that are an exact or likely duplicate of a row of the ledger, or of one with a smaller id in the batch, are marked for review."""
    fresh = incoming.dropDuplicates(["txn_id"])
    if existing is not None:
        fresh = fresh.join(existing.select("txn_id"), "txn_id", "left_anti")
    found = duplicates.within_batch(fresh).select("incoming_id")
    if existing is not None:
        found = found.unionByName(duplicates.candidates(existing, fresh).select("incoming_id"))
    doubled = found.select(F.col("incoming_id").alias("txn_id")).distinct().withColumn("doubled", F.lit(True))
    return fresh.join(doubled, "txn_id", "left").withColumn("review_state", F.when(F.col("doubled"), "needsReview").otherwise(F.col("review_state"))).drop("doubled")


def take(spark: SparkSession, path: str, stream: str, batch: DataFrame, batch_id: int) -> snapshots.Snapshot:
    """Commits one batch of ``stream``, unless it has been taken."""

    def change(at: snapshots.Snapshot) -> snapshots.Snapshot:
        if at.taken.get(stream, -1) >= batch_id:
            return at
        rows = fresh_rows(snapshots.table(spark, path, at, LEDGER), batch)
        prints = duplicates.with_keys(rows).select("txn_id", "account_id", "fingerprint")
        line = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("review_state") == "needsReview").alias("n_review")).select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch"), "n_rows", "n_review")
        return snapshots.commit(spark, path, at, {LEDGER: snapshots.Change(rows), PRINTS: snapshots.Change(prints), IMPORTS: snapshots.Change(line)}, taken=(stream, batch_id))

    return snapshots.retried(spark, path, change)


def start(rows: DataFrame, path: str, checkpoint: str):
    """Runs a stream of canonical transactions into the workspace at ``path``; all that is there is taken, then the query ends. The checkpoint is the stream's name in the revisions."""
    return rows.writeStream.foreachBatch(lambda batch, batch_id: take(batch.sparkSession, path, checkpoint, batch, batch_id) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
