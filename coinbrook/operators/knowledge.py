"""Portable knowledge, backups, journals and the checks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.functions import money
from coinbrook.operators import ranks


def canonical_json(*columns: str) -> Column:
    """JSON of a row with its keys in alphabetical order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def merge_plan(local: DataFrame, incoming: DataFrame, guarded: tuple[str, ...] = ()) -> DataFrame:
    """id and change (add, unchanged, conflict, update) of each incoming row; a conflict is a change of a guarded column. Both have the same columns."""
    columns = [c for c in incoming.columns if c != "id"]
    mine = local.select("id", F.struct(*columns).alias("local"))
    both = incoming.select("id", F.struct(*columns).alias("incoming")).join(mine, "id", "left")
    same = F.to_json("local") == F.to_json("incoming")
    clash = F.lit(False)
    for c in guarded:
        clash |= ~F.col(f"local.{c}").eqNullSafe(F.col(f"incoming.{c}"))
    change = F.when(F.col("local").isNull(), "add").when(same, "unchanged").when(clash, "conflict").otherwise("update")
    return both.select("id", change.alias("change"))


def semantic_duplicates(local: DataFrame, incoming: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """incoming_id and local_id (the first by ordinal) where a new row has the name, and the ``also`` columns, of a local one with another id."""
    key = [F.lower("name").alias("low"), *also]
    new = incoming.join(local.select("id"), "id", "left_anti").select(F.col("id").alias("incoming_id"), *key)
    mine = local.select(F.col("id").alias("local_id"), "ordinal", *key)
    first = F.min(F.struct("ordinal", "local_id")).alias("f")
    return new.join(mine, ["low", *also]).groupBy("incoming_id").agg(first).select("incoming_id", F.col("f.local_id").alias("local_id"))


def can_apply(plan: DataFrame, duplicates: DataFrame, resolved: DataFrame | None = None, acknowledged: DataFrame | None = None) -> DataFrame:
    """One row: open_conflicts, open_duplicates and ok."""
    conflicts = plan.filter("change = 'conflict'")
    if resolved is not None:
        conflicts = conflicts.join(resolved.select("id"), "id", "left_anti")
    if acknowledged is not None:
        duplicates = duplicates.join(acknowledged.select("incoming_id"), "incoming_id", "left_anti")
    each = conflicts.select(F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(duplicates.select(F.lit(0).alias("c"), F.lit(1).alias("d")))
    n = each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("open_conflicts"), F.coalesce(F.sum("d"), F.lit(0)).alias("open_duplicates"))
    return n.withColumn("ok", (F.col("open_conflicts") == 0) & (F.col("open_duplicates") == 0))


def restore_conflicts(local: DataFrame, backup: DataFrame) -> DataFrame:
    """Ids that both sides have with different content."""
    columns = [c for c in backup.columns if c != "id"]
    a = local.select("id", F.to_json(F.struct(*sorted(columns))).alias("mine"))
    return a.join(backup.select("id", F.to_json(F.struct(*sorted(columns))).alias("theirs")), "id").filter("mine <> theirs").select("id")


def restore_merge(local: DataFrame, backup: DataFrame) -> DataFrame:
    """Local rows, and those of the backup whose ids are new."""
    return local.unionByName(backup.join(local.select("id"), "id", "left_anti"))


def manifest(sections: dict[str, DataFrame]) -> DataFrame:
    """section, n_rows, n_bytes and digest of each section. The digest does not depend on order: it folds the rows' own digests by sum and by exclusive or, so it is a partial aggregate and no section is gathered."""
    out = None
    for name, df in sections.items():
        body = canonical_json(*df.columns)
        h = F.sha2(body, 256)
        part = lambda at, h=h: F.conv(F.substring(h, at, 15), 16, 10).cast("long")
        one = df.select(body.alias("b"), *[part(at).alias(f"h{k}") for k, at in enumerate((1, 16, 31))])
        row = one.agg(
            F.count("*").alias("n_rows"),
            F.coalesce(F.sum(F.octet_length("b")), F.lit(0)).cast("long").alias("n_bytes"),
            F.sha2(F.concat_ws(":", *[F.coalesce(F.bit_xor(f"h{k}"), F.lit(0)).cast("string") for k in range(3)], *[F.coalesce(F.sum(F.col(f"h{k}").cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(3)]), 256).alias("digest"),
        ).select(F.lit(name).alias("section"), "n_rows", "n_bytes", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def verify_manifest(expected: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """Sections whose count or digest differs from ``expected``, or that one side lacks."""
    have = manifest(sections).select("section", F.col("n_rows").alias("have_rows"), F.col("digest").alias("have_digest"))
    both = expected.join(have, "section", "full")
    return both.filter(~(F.col("n_rows").eqNullSafe(F.col("have_rows")) & F.col("digest").eqNullSafe(F.col("have_digest")))).select("section")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no parent; null references are fine."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").cast("long").alias("n")).filter("n > 1")


def closure(workspace_accounts: DataFrame, transactions: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transactions of a workspace's accounts, and their fingerprints."""
    own = transactions.join(workspace_accounts.select("account_id"), "account_id", "left_semi")
    return own, fingerprints.join(own.select("txn_id"), "txn_id", "left_semi")


def latest_events(events: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """The newest event of each aggregate (aggregate_id, occurred_at, event_id) that is not undone; of equal times the larger id. An aggregate, so a long log is no window."""
    live = events if undone is None else events.join(undone.select("event_id"), "event_id", "left_anti")
    return live.groupBy("aggregate_id").agg(F.max(F.struct("occurred_at", "event_id")).alias("e")).select("aggregate_id", "e.occurred_at", "e.event_id")


def retained(journal: DataFrame, keep: int = 999) -> DataFrame:
    """The newest ``keep`` entries of each store, before one is added."""
    w = Window.partitionBy("store").orderBy(F.desc("created_at"), F.desc("id"))
    return journal.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("rank")


def category_problems(categories: DataFrame) -> DataFrame:
    """category_id and problem: missing parents, and more than three levels (cycles are that too)."""
    c = categories.select("category_id", "parent_id")
    missing = c.filter("parent_id is not null").join(c.select(F.col("category_id").alias("parent_id")), "parent_id", "left_anti").select("category_id", F.lit("no such parent").alias("problem"))
    up = lambda df, n: df.join(c.select(F.col("category_id").alias(f"p{n}"), F.col("parent_id").alias(f"p{n + 1}")), f"p{n}", "left")
    deep = up(up(c.withColumnRenamed("parent_id", "p1"), 1), 2).filter("p3 is not null").select("category_id", F.lit("more than three levels").alias("problem"))
    return missing.unionByName(deep)


def deletable_accounts(accounts: DataFrame, *referring: DataFrame) -> DataFrame:
    """Accounts that no row of ``referring`` (account_id) names."""
    out = accounts
    for r in referring:
        out = out.join(r.select("account_id"), "account_id", "left_anti")
    return out


def bad_transactions(ledger: DataFrame) -> DataFrame:
    """txn_id and problem of rows that break the limits of a transaction."""
    checks = {
        "description": F.length("description").between(1, 1000),
        "status": F.col("status").isin("posted", "pending", "void"),
        "review_state": F.col("review_state").isin("unreviewed", "needsReview", "reviewed"),
        "currency": F.col("currency").rlike("^[A-Z]{3}$"),
        "amount": F.col("amount").isNotNull(),
        "tags": (F.size("tags") <= 50) & (F.size(F.array_distinct("tags")) == F.size("tags")) & F.forall("tags", lambda t: F.length(t).between(1, 60)),
        "notes": F.col("notes").isNull() | (F.length("notes") <= 2000),
    }
    problems = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return ledger.select("txn_id", F.explode(problems).alias("problem"))


def percentile_index(values: DataFrame, key: list[str], value: str, p: float) -> DataFrame:
    """sorted[min(n - 1, floor(p n))] of each group."""
    return ranks.value_at(values, key, value, lambda n: F.least(n - 1, F.floor(n * p)), "value")


def evaluation_metrics(outcomes: DataFrame) -> DataFrame:
    """Rates of an evaluation by task: outcomes has task, valid, abstained, should_abstain and correct (booleans)."""
    n = money.count_if
    a, s = F.col("abstained"), F.col("should_abstain")
    rate = lambda x, y: F.when(y > 0, x / y)
    counts = outcomes.groupBy("task").agg(F.count("*").cast("long").alias("n"), n(F.col("valid")).alias("n_valid"), n(~a).alias("n_answered"), n(~a & F.col("correct")).alias("n_correct"), n(a).alias("n_abstained"), n(a & s).alias("n_right_abstained"), n(s).alias("n_should_abstain"))
    return counts.select(
        "task", "n", rate(F.col("n_valid"), F.col("n")).alias("valid_rate"), rate(F.col("n_correct"), F.col("n_answered")).alias("accuracy"),
        rate(F.col("n_right_abstained"), F.col("n_abstained")).alias("abstention_precision"), rate(F.col("n_right_abstained"), F.col("n_should_abstain")).alias("abstention_recall"),
    )


#: What an evaluation has to reach.
MOST_INVALID, LEAST_ACCURACY, LEAST_ABSTENTION_RECALL, MOST_LATENCY_P95 = 0.02, 0.8, 0.7, 2000


def evaluation(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of each run, with their denominators; a rate over nothing is 0.

    outcomes: run, case_id, kind (invalidOutput, abstained or anything else), correct,
    grounding_violation, privacy_violation (null is false) and latency_ms. cases: run,
    case_id, expected_abstention. Accuracy is over the outcomes of cases that have an answer;
    an outcome without a case counts as such. Runs without outcomes are missing. Latencies
    are taken at ranks, with no run in one task.
    """
    expected = cases.filter("expected_abstention").select("run", "case_id").distinct().withColumn("expected", F.lit(True))
    abstained, yes = F.col("kind") == "abstained", lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: money.count_if(F.coalesce(c, F.lit(False)))
    counts = outcomes.join(expected, ["run", "case_id"], "left").groupBy("run").agg(
        F.count("*").cast("long").alias("total"), n(~yes("expected")).alias("answerable"), n(abstained).alias("did_abstain"), n(F.col("kind") == "invalidOutput").alias("n_invalid"),
        n(~yes("expected") & yes("correct")).alias("n_correct"), n(abstained & yes("expected")).alias("n_right"), n(yes("grounding_violation")).alias("grounding_violations"), n(yes("privacy_violation")).alias("privacy_violations"),
    )
    at = lambda p, name: ranks.value_at(outcomes, ["run"], "latency_ms", lambda size: F.least(size - 1, F.floor(size * p)), name)
    rate = lambda x, y: F.when(F.col(y) > 0, x / F.col(y)).otherwise(0.0)
    both = counts.join(expected.groupBy("run").agg(F.count("*").alias("should_abstain")), "run", "left").withColumn("should_abstain", F.coalesce("should_abstain", F.lit(0)).cast("long"))
    rates = both.select(
        "run", "total", "answerable", "should_abstain", "did_abstain", rate(F.col("total") - F.col("n_invalid"), "total").alias("valid_rate"), rate(F.col("n_invalid"), "total").alias("invalid_rate"), rate(F.col("n_correct"), "answerable").alias("accuracy"),
        rate(F.col("n_right"), "did_abstain").alias("abstention_precision"), rate(F.col("n_right"), "should_abstain").alias("abstention_recall"), "grounding_violations", "privacy_violations",
    )
    return rates.join(at(0.5, "latency_median"), "run", "left").join(at(0.95, "latency_p95"), "run", "left")


def evaluation_gates(metrics: DataFrame) -> DataFrame:
    """run, status and failures: failed if a safety gate does not hold, whatever the quality; else experimental if quality or latency is missed; else supported."""
    named = lambda gates: F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in gates]), lambda g: g.isNotNull())
    c = F.col
    safety = named([("privacy_violations", c("privacy_violations") > 0), ("grounding_violations", c("grounding_violations") > 0), ("invalid_rate", c("invalid_rate") > MOST_INVALID)])
    quality = named([("accuracy", c("accuracy") < LEAST_ACCURACY), ("abstention_recall", c("abstention_recall") < LEAST_ABSTENTION_RECALL), ("latency_p95", c("latency_p95") > MOST_LATENCY_P95)])
    status = F.when(F.size(safety) > 0, "failed").when(F.size(quality) > 0, "experimental").otherwise("supported")
    return metrics.select("run", status.alias("status"), F.when(F.size(safety) > 0, safety).otherwise(quality).alias("failures"))


def performance_regressions(baseline: DataFrame, current: DataFrame, threshold: float = 1.2) -> DataFrame:
    """Metrics (profile, workload, metric, median) of the same profile and workload whose median grew past ``threshold`` times the baseline's."""
    key = ["profile", "workload", "metric"]
    both = baseline.select(*key, F.col("median").alias("before")).join(current.select(*key, F.col("median").alias("after")), key)
    return both.filter(F.col("after") > F.col("before") * threshold)


def suggestion_batches(ledger: DataFrame, normalized: str = "normalized") -> DataFrame:
    """direction, description and number of rows of each batch for suggestions."""
    direction = F.when(money.is_inflow(F.col("amount")), "inflow").otherwise("outflow")
    return ledger.groupBy(direction.alias("direction"), normalized).agg(F.count("*").cast("long").alias("n"), F.min("txn_id").alias("first_id"))


def suggestion_eligible(ledger: DataFrame, rejected: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows, by id, that are live, unresolved, unlocked and not rejected before (txn_id)."""
    live = ledger.filter((F.col("status") != "void") & F.col("category_id").isNull() & ~F.coalesce("category_locked", F.lit(False)))
    return live.join(rejected.select("txn_id"), "txn_id", "left_anti").orderBy("txn_id").limit(limit)


def queue_eligible(queue: DataFrame, rejected: DataFrame, classifier_version: str, limit: int | None = None, order: str = "txn_id") -> DataFrame:
    """Rows of a review queue (status, normalized, category_locked, merchant_locked) that a suggestion may be made for: live, with neither lock, and not rejected before as (normalized, classifier_version); the first ``limit`` in ``order``."""
    free = ~F.coalesce("category_locked", F.lit(False)) & ~F.coalesce("merchant_locked", F.lit(False))
    said_no = rejected.filter(F.col("classifier_version") == classifier_version).select("normalized").distinct()
    open_rows = queue.filter((F.col("status") != "void") & free).join(said_no, "normalized", "left_anti")
    return open_rows if limit is None else open_rows.orderBy(order).limit(limit)


def suggestion_members(rows: DataFrame, normalized: str = "normalized") -> DataFrame:
    """The rows behind ``suggestion_batches``, one each: direction, description, txn_id and updated_at, by which acceptance tells whether a row has changed since. Batches hold no lists: one may have any share of the ledger."""
    return rows.select(F.when(money.is_inflow(F.col("amount")), "inflow").otherwise("outflow").alias("direction"), normalized, "txn_id", "updated_at")
