"""Lifecycles of decisions on transfers and recurring series, as logs of events and folds over them.

An event has aggregate_id, seq (unique in its aggregate), action and whatever it sets. ``undo``
takes back the last event of its aggregate that still stands, so a log reads like brackets:
every event opens a level and every undo closes one. Which events stand is found by two
running minima over an aggregate's log; the log of one aggregate is sorted, never gathered.

Commands are judged against a state and come out as events or refusals; nothing is written
here. Statuses of links: proposed, confirmed, rejected, unlinked. Of recurring decisions:
confirmed, dismissed, muted, superseded, invalidated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.operators import recurring
from coinbrook.streaming.snapshots import shared_dir

#: Status that an action leads to; edit keeps the one before.
LINK_STATUS = {"confirm": "confirmed", "reject": "rejected", "unlink": "unlinked", "invalidate-source": "unlinked"}
DECISION_STATUS = {"confirm": "confirmed", "dismiss": "dismissed", "mute": "muted", "merge": "superseded", "split": "superseded", "invalidate": "invalidated", "invalidate-source": "invalidated"}


def standing(events: DataFrame) -> DataFrame:
    """The events that no undo takes back. An undo of an aggregate without a standing event does nothing."""
    so_far = Window.partitionBy("aggregate_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("aggregate_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    step = F.when(F.col("action") == "undo", -1).otherwise(1)
    levels = events.withColumn("_s", F.sum(step).over(so_far)).withColumn("_level", F.col("_s") - F.least(F.min("_s").over(so_far), F.lit(0)))
    stays = F.col("_level") <= F.coalesce(F.min("_level").over(ahead), F.col("_level"))
    return levels.withColumn("_stays", stays).filter((F.col("action") != "undo") & F.col("_stays")).drop("_s", "_level", "_stays")


def state(events: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """aggregate_id, status, last_action and n_standing of each aggregate with a standing event: the last action that sets a status says which."""
    status = F.element_at(F.create_map(*[F.lit(x) for pair in statuses.items() for x in pair]), F.col("action"))
    rows = standing(events).withColumn("status", status)
    last = lambda value, when=None: F.max(F.when(F.lit(True) if when is None else when, F.struct("seq", value)))
    out = rows.groupBy("aggregate_id").agg(last("status", F.col("status").isNotNull()).alias("s"), last("action").alias("a"), F.count("*").alias("n_standing"))
    return out.select("aggregate_id", F.col("s.status").alias("status"), F.col("a.action").alias("last_action"), "n_standing")


# Transfers


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: what is read several times is computed once."""
    path = f"{shared_dir(df.sparkSession)}/commands-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def judged_confirmations(commands: DataFrame, proposals: DataFrame, ledger: DataFrame, links: DataFrame) -> DataFrame:
    """commands (seq, signature) with outflow_id, inflow_id and refusal (null: confirmed).

    proposals: signature, is_ambiguous, and id, account, date and amount of both sides as
    proposed (outflow_id, outflow_account, outflow_date, outflow_amount, and inflow_...).
    links: signature, status, outflow_id, inflow_id. Refused are unknown and ambiguous proposals,
    those of which a side has changed or is no longer posted, and those of which a side is in
    another confirmed link: an older one, or one that an earlier command of these confirms.
    """
    sides = ("outflow", "inflow")
    rows = commands.select("seq", "signature").join(proposals, "signature", "left")
    now = ledger.filter("status = 'posted'").select("txn_id", "account_id", "posted_date", "amount")
    taken = links.filter("status = 'confirmed'").select(F.explode(F.array("outflow_id", "inflow_id")).alias("txn_id"), F.col("signature").alias("by"))
    for side in sides:
        own = now.select(F.col("txn_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_now_{c}") for c in ("account_id", "posted_date", "amount")])
        same = (F.col(f"{side}_now_account_id") == F.col(f"{side}_account")) & (F.col(f"{side}_now_posted_date") == F.col(f"{side}_date")) & (F.col(f"{side}_now_amount") == F.col(f"{side}_amount"))
        rows = rows.join(own, f"{side}_id", "left").withColumn(f"{side}_same", F.coalesce(same, F.lit(False)))
        by = taken.groupBy(F.col("txn_id").alias(f"{side}_id")).agg(F.collect_set("by").alias(f"{side}_by"))  # a transaction is in one confirmed link
        rows = rows.join(by, f"{side}_id", "left").withColumn(f"{side}_taken", F.exists(F.coalesce(f"{side}_by", F.array().cast("array<string>")), lambda s: s != F.col("signature")))
    refusal = F.when(F.col("is_ambiguous").isNull(), "unknown").when(F.col("is_ambiguous"), "ambiguous").when(~(F.col("outflow_same") & F.col("inflow_same")), "stale").when(F.col("outflow_taken") | F.col("inflow_taken"), "reused")
    judged = cut(rows.select("seq", "signature", "outflow_id", "inflow_id", refusal.alias("refusal")))
    return _in_order(judged)


def _in_order(judged: DataFrame) -> DataFrame:
    """Refuses what shares a side with an earlier accepted command of another pair. In each round those are settled that are the earliest open ones on both their sides; chains of commands, which are short, set the number of rounds."""
    open_, done = judged.filter("refusal IS NULL"), judged.filter("refusal IS NOT NULL")
    while not open_.isEmpty():
        each = open_.select("seq", F.explode(F.array("outflow_id", "inflow_id")).alias("txn_id"))
        first = each.groupBy("txn_id").agg(F.min("seq").alias("first"))
        wins = each.join(first, "txn_id").groupBy("seq").agg(F.min(F.col("seq") == F.col("first")).alias("wins"))
        settled = open_.join(wins.filter("wins"), "seq").drop("wins")
        used = settled.select("seq", F.col("signature").alias("by"), F.explode(F.array("outflow_id", "inflow_id")).alias("txn_id"))
        rest = open_.join(settled.select("seq"), "seq", "left_anti")
        hit = rest.select("seq", "signature", F.explode(F.array("outflow_id", "inflow_id")).alias("txn_id")).join(used.drop("seq"), "txn_id").groupBy("seq").agg(F.max(F.col("by") != F.col("signature")).alias("other"))
        # The same pair again is confirmed again.
        after = rest.join(hit, "seq", "left").withColumn("refusal", F.when(F.col("other"), "reused"))
        again = F.coalesce(~F.col("other"), F.lit(False))
        done = done.unionByName(settled).unionByName(after.filter(F.col("refusal").isNotNull() | again).select(*judged.columns))
        done, open_ = cut(done), cut(after.filter(F.col("refusal").isNull() & ~again).select(*judged.columns))
    return done


# Recurring series


def merges(decisions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New decisions (key, signature, name, cadence), their parts (key, signature) and refusals (merge_id, problem) of merges: wanted has merge_id, name, ordinal and signature, a row for each series to merge.

    A new signature names all that was merged and may be long, so it stands in one row; parts
    have its digest as key.
    """
    known = wanted.join(decisions.select("signature", "cadence", F.lit(True).alias("known")), "signature", "left")
    each = known.groupBy("merge_id").agg(
        F.count_distinct("signature").alias("n"), F.count_if(F.col("known").isNull()).alias("unknown"), F.first("name").alias("name"), F.min(F.struct("ordinal", "cadence")).alias("first"), F.array_sort(F.collect_set("signature")).alias("parts")
    )
    problem = F.when(F.col("unknown") > 0, "unknown series").when(F.col("n") < 2, "fewer than two series")
    new = F.concat(F.lit("merged:"), F.array_join("parts", ":"))
    good = each.filter(problem.isNull()).select("merge_id", new.alias("signature"), F.substring(F.trim("name"), 1, 120).alias("name"), F.col("first.cadence").alias("cadence")).withColumn("key", F.sha2(F.col("signature"), 256))
    parts = wanted.join(good.select("merge_id", "key"), "merge_id").select("key", "signature").distinct()
    return good.select("key", "signature", "name", "cadence"), parts, each.filter(problem.isNotNull()).select("merge_id", problem.alias("problem"))


def merged_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key and txn_id: the members of the ``parts`` of ``merges``, each once in a new decision."""
    return members.join(parts, "signature").select("key", "txn_id").distinct()


def merged_decisions(decisions: DataFrame, added: DataFrame, parts: DataFrame) -> DataFrame:
    """Decisions with those that ``merges`` adds; its parts are superseded."""
    new = added.select("signature", "name", F.lit("confirmed").alias("status"), "cadence", F.lit(None).cast("int").alias("tolerance_days"), F.lit("user-merged-v1").alias("detector_version"))
    return _superseded(decisions, parts).unionByName(new.select(*decisions.columns))


def merged(decisions: DataFrame, members: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, members and refusals (merge_id, problem) after merges: wanted has merge_id, name, ordinal and signature, a row for each series to merge.

    decisions: signature, name, status, cadence, tolerance_days, detector_version. members:
    signature, txn_id. The new decision's signature names the merged ones in order; it has their
    members once, and the cadence of the first. Those merged are superseded. Every member gets
    its decision's whole signature here; where many series are merged, work with the keys of
    ``merges`` instead.
    """
    added, parts, bad = merges(decisions, wanted)
    own = merged_members(members, parts).join(added.select("key", "signature").dropDuplicates(["key"]), "key").select("signature", "txn_id")
    return merged_decisions(decisions, added, parts), members.unionByName(own), bad


def _superseded(decisions: DataFrame, parts: DataFrame) -> DataFrame:
    hit = parts.select("signature").distinct().withColumn("_hit", F.lit(True))
    return decisions.join(hit, "signature", "left").withColumn("status", F.when(F.col("_hit"), "superseded").otherwise(F.col("status"))).select(*decisions.columns)


def split(decisions: DataFrame, members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, members and refusals (signature, problem) after splits: groups has signature, child (1, 2, ...), name and txn_id, and must hold each member of a series exactly once, in two groups at least.

    Children are confirmed and have the cadence and tolerance of the series, which is superseded.
    """
    dealt = groups.groupBy("signature", "txn_id").agg(F.count("*").alias("times"))
    own = members.join(groups.select("signature").distinct(), "signature", "left_semi").withColumn("member", F.lit(True))
    exact = own.join(dealt, ["signature", "txn_id"], "full").groupBy("signature").agg(F.bool_and(F.col("member").isNotNull() & (F.coalesce("times", F.lit(0)) == 1)).alias("exact"))
    n = groups.groupBy("signature").agg(F.count_distinct("child").alias("n"))
    checked = n.join(exact, "signature", "left").join(decisions.select("signature", "cadence", "tolerance_days", F.lit(True).alias("known")), "signature", "left")
    problem = F.when(F.col("known").isNull(), "unknown series").when(F.col("n") < 2, "fewer than two groups").when(~F.coalesce("exact", F.lit(False)), "no partition of the members")
    good = checked.filter(problem.isNull())
    new = F.concat(F.lit("split:"), "signature", F.lit(":"), F.col("child").cast("string"))
    children = groups.groupBy("signature", "child").agg(F.first("name").alias("name")).join(good, "signature")
    added = children.select(new.alias("signature"), F.substring(F.trim("name"), 1, 120).alias("name"), F.lit("confirmed").alias("status"), "cadence", "tolerance_days", F.lit("user-split-v1").alias("detector_version"))
    moved = groups.join(good.select("signature"), "signature", "left_semi").select(new.alias("signature"), "txn_id")
    return _superseded(decisions, good).unionByName(added.select(*decisions.columns)), members.unionByName(moved), checked.filter(problem.isNotNull()).select("signature", problem.alias("problem"))


def reconciled(decisions: DataFrame, members: DataFrame, ledger: DataFrame, detector: str = recurring.DETECTOR) -> DataFrame:
    """Decisions after those of a detector are invalidated that another version made, or of which a member is not posted; what users made by merging and splitting stays."""
    old = recurring.stale(decisions.withColumn("decision_id", F.col("signature")), members.withColumnRenamed("signature", "decision_id"), ledger, detector).select("signature").withColumn("_old", F.lit(True))
    return decisions.join(old, "signature", "left").withColumn("status", F.when(F.col("_old"), "invalidated").otherwise(F.col("status"))).select(*decisions.columns)


def void_events(voided: DataFrame, cause: str, links: DataFrame, decisions: DataFrame, members: DataFrame) -> DataFrame:
    """event_id, aggregate_type, aggregate_id, action, before and after (statuses): what voiding transactions does to confirmed links and confirmed decisions, whoever made these."""
    gone = voided.select("txn_id").distinct()
    sides = links.filter("status = 'confirmed'").select("signature", F.explode(F.array("outflow_id", "inflow_id")).alias("txn_id"))
    hit = lambda df: df.join(gone, "txn_id", "left_semi").select("signature").distinct()
    confirmed = decisions.filter("status = 'confirmed'").select("signature")
    event = lambda df, kind, after: df.select(F.concat(F.lit(f"{cause}:{kind}:"), "signature").alias("event_id"), F.lit(kind).alias("aggregate_type"), F.col("signature").alias("aggregate_id"), F.lit("invalidate-source").alias("action"), F.lit("confirmed").alias("before"), F.lit(after).alias("after"))
    return event(hit(sides), "transfer", "unlinked").unionByName(event(hit(members.join(confirmed, "signature", "left_semi")), "recurring", "invalidated"))


def applied(table: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """Links or decisions with the statuses that ``void_events`` sets."""
    new = events.filter(F.col("aggregate_type") == kind).select(F.col("aggregate_id").alias("signature"), F.col("after").alias("_after"))
    return table.join(new, "signature", "left").withColumn("status", F.coalesce("_after", "status")).select(*table.columns)
