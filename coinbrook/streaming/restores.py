"""Restoring a backup's tables into a workspace: as a new one, in place of all, or merged; and accepting suggestions that are still current.

A restore is one commit. ``new`` is refused where the workspace has tables, ``replace`` leaves
nothing that the backup lacks, ``merge`` keeps local rows and adds those with new keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.operators import knowledge
from coinbrook.operators.learning import image
from coinbrook.streaming import snapshots
from coinbrook.streaming.snapshots import Change, Snapshot

MODES = ("new", "replace", "merge")


class RestoreRefused(ValueError):
    """A restore that may not be applied; nothing has been written."""


def conflicts(local: dict[str, DataFrame], backup: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """section and key of rows that both sides have with different content."""
    out = []
    for name, key in keys.items():
        if name in local and name in backup:
            shared = [c for c in backup[name].columns if c in local[name].columns]
            side = lambda df, as_, key=key, shared=shared: df.select(F.col(key).cast("string").alias("key"), image(shared).alias(as_))
            out.append(side(local[name], "mine").join(side(backup[name], "theirs"), "key").filter("mine <> theirs").select(F.lit(name).alias("section"), "key"))
    return reduce(DataFrame.unionByName, out) if out else next(iter(backup.values())).sparkSession.createDataFrame([], "section string, key string")


def restore(spark: SparkSession, path: str, at: Snapshot, backup: dict[str, DataFrame], keys: dict[str, str], mode: str, manifest: DataFrame | None = None) -> Snapshot:
    """The workspace after a restore of ``backup`` (a table a section; ``keys``: their key columns). ``manifest``: what the sections have to be, counts and digests; a difference is refused."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if manifest is not None:
        broken = [r[0] for r in knowledge.verify_manifest(manifest, backup).collect()]
        if broken:
            raise RestoreRefused(f"sections differ from their manifest: {', '.join(sorted(broken))}")
    if mode == "new" and at.tables:
        raise RestoreRefused("the workspace has tables already")
    if mode != "merge":
        gone = {name: Change(None, None) for name in at.tables if name not in backup}
        return snapshots.commit(spark, path, at, gone | {name: snapshots.replaced(df) for name, df in backup.items()})
    local = snapshots.read(spark, path, at)
    fresh = lambda name, df: df.join(local[name].select(keys[name]), keys[name], "left_anti") if name in local else df
    return snapshots.commit(spark, path, at, {name: Change(fresh(name, df)) for name, df in backup.items()})


def judged_suggestions(wanted: DataFrame, suggestions: DataFrame, ledger: DataFrame, queue: DataFrame) -> DataFrame:
    """suggestion_id, txn_id, problem (null: accepted), new_status and the category and merchant to set, for each suggestion that is to be accepted.

    wanted: suggestion_id, merchant_id (the resolved one, for merchants). suggestions:
    suggestion_id, status, kind (category, merchant, abstain), txn_id, updated_at (the row's when
    it was suggested), category_id. ledger: txn_id, updated_at, category_locked, merchant_locked.
    queue: txn_id of the rows that still need a look. A row that has changed, is resolved by
    now, or is locked makes a suggestion stale.
    """
    own = suggestions.withColumnRenamed("updated_at", "seen_at")
    now = ledger.select("txn_id", "updated_at", (F.coalesce("category_locked", F.lit(False)) | F.coalesce("merchant_locked", F.lit(False))).alias("locked"))
    open_ = queue.select("txn_id").distinct().withColumn("open", F.lit(True))
    rows = wanted.join(own, "suggestion_id", "left").join(now, "txn_id", "left").join(open_, "txn_id", "left")
    problem: Column = (
        F.when(F.col("status").isNull(), "not found")
        .when(F.col("status") != "pending", F.concat(F.lit("is "), "status"))
        .when(F.col("kind") == "abstain", "abstention")
        .when(~F.col("updated_at").eqNullSafe(F.col("seen_at")) | F.col("updated_at").isNull(), "changed")
        .when(F.col("open").isNull() | F.col("locked"), "resolved")
        .when((F.col("kind") == "merchant") & F.col("merchant_id").isNull(), "no merchant")
    )
    status = F.when(problem.isNull(), "accepted").when(problem.isin("changed", "resolved"), "stale").otherwise(F.col("status"))
    good = lambda kind, c: F.when(problem.isNull() & (F.col("kind") == kind), F.col(c)).alias(c)
    return rows.select("suggestion_id", "txn_id", problem.alias("problem"), status.alias("new_status"), good("category", "category_id"), good("merchant", "merchant_id"))
