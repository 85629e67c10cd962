"""Transfers between accounts: pairs of an outflow and an inflow, and their life.

All pairs of one currency and two accounts within the days and the fee are proposals;
nothing is assigned greedily. The range join becomes an equal join: a side carries the
bucket of its day and of its amount, the other also the buckets beside them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import money

EXACT, FEE, BASE = 5000, 2000, 5000


def signature(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.array_sort(F.array(a.cast("string"), b.cast("string"))))


def pairs(ledger: DataFrame, max_days: int = 3, max_fee: Decimal | str = "10.00") -> DataFrame:
    """signature, outflow_id, inflow_id, currency, days, fee (null if exact), score and is_ambiguous of all proposals."""
    fee = Decimal(max_fee)
    if fee < 0:
        raise ValueError("the largest fee must not be negative")
    wide_days, wide_amount = max_days + 1, F.lit(max(fee, Decimal("0.01"))).cast("decimal(18,2)")
    posted = ledger.filter("status = 'posted'").withColumn("size", F.abs("amount").cast(money.TOTAL))
    day = F.floor(F.datediff("posted_date", F.lit("1970-01-01").cast("date")) / wide_days).cast("int")
    amount = F.floor(F.col("size") / wide_amount).cast("long")
    beside = lambda x, kind: F.explode(F.array(*[(x + d).cast(kind) for d in (-1, 0, 1)]))
    keep = ["txn_id", "account_id", "currency", "posted_date", "size"]
    out = posted.filter(money.is_outflow(F.col("amount"))).select(*[F.col(c).alias(f"o_{c}") for c in keep], "currency", day.alias("day"), amount.alias("bucket"))
    into = posted.filter(money.is_inflow(F.col("amount"))).select(*[F.col(c).alias(f"i_{c}") for c in keep], "currency", beside(day, "int").alias("day"), amount.alias("bucket")).withColumn("bucket", beside(F.col("bucket"), "long"))
    days, diff = F.abs(F.datediff("o_posted_date", "i_posted_date")), F.abs(F.col("o_size") - F.col("i_size"))
    met = out.join(into, ["currency", "day", "bucket"]).filter((F.col("o_account_id") != F.col("i_account_id")) & (days <= max_days) & (diff <= F.lit(fee)))
    exact = diff == 0
    found = met.select(
        signature(F.col("o_txn_id"), F.col("i_txn_id")).alias("signature"), F.col("o_txn_id").alias("outflow_id"), F.col("i_txn_id").alias("inflow_id"), "currency", days.cast("int").alias("days"),
        F.when(~exact, diff).cast(money.TOTAL).alias("fee"), (BASE + 2000 - 300 * days + F.when(exact, EXACT).otherwise(FEE)).cast("int").alias("score"),
    )
    return with_ambiguity(found)


def with_ambiguity(found: DataFrame) -> DataFrame:
    """Marks pairs of which a side is in another pair too. The counts are aggregates joined back, so a transaction in very many pairs is never one window."""
    used = lambda side: found.groupBy(side).agg(F.count("*").alias(f"n_{side}"))
    both = found.join(used("outflow_id"), "outflow_id").join(used("inflow_id"), "inflow_id")
    return both.withColumn("is_ambiguous", (F.col("n_outflow_id") > 1) | (F.col("n_inflow_id") > 1)).select(*found.columns, "is_ambiguous")


def evidence(found: DataFrame) -> DataFrame:
    """Each pair's evidence as code and weight. The weights are not the parts of the score."""
    item = lambda code, weight: F.struct(code.alias("code"), weight.cast("int").alias("weight"))
    items = [
        item(F.lit("opposite-direction"), F.lit(3000)),
        item(F.concat(F.lit("date-distance:"), F.col("days").cast("string")), 2000 - 300 * F.col("days")),
        F.when(F.col("fee").isNull(), item(F.lit("equal-amount"), F.lit(EXACT))).otherwise(item(F.lit("possible-fee"), F.lit(FEE))),
        F.when(F.col("is_ambiguous"), item(F.lit("ambiguous-candidate-count"), F.lit(-1000))),
    ]
    return found.withColumn("evidence", F.filter(F.array(*items), lambda x: x.isNotNull()))


def unresolved(found: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that no confirmed or rejected link (signature, status) settles."""
    return found.join(links.filter("status in ('confirmed', 'rejected')").select("signature"), "signature", "left_anti")


def confirmed_ids(links: DataFrame) -> DataFrame:
    """txn_id of both sides of the confirmed links."""
    return links.filter("status = 'confirmed'").select(F.explode(F.array("outflow_id", "inflow_id")).alias("txn_id")).distinct()


def confirmable(found: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that may be confirmed: not ambiguous, unsettled, and no side in a confirmed link."""
    taken = confirmed_ids(links)
    free = unresolved(found, links).filter("not is_ambiguous")
    for side in ("outflow_id", "inflow_id"):
        free = free.join(taken.withColumnRenamed("txn_id", side), side, "left_anti")
    return free.select(*found.columns)


def decided(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Links after ``changes`` (signature, status): each known link takes its new status, confirm only from proposed, unlink only from confirmed."""
    joined = links.join(changes.withColumnRenamed("status", "new_status"), "signature", "left")
    allowed = (F.col("new_status") == "confirmed") & (F.col("status") == "proposed") | (F.col("new_status") == "rejected") & (F.col("status") == "proposed") | (F.col("new_status") == "unlinked") & (F.col("status") == "confirmed")
    return joined.withColumn("status", F.when(allowed, F.col("new_status")).otherwise(F.col("status"))).select(*links.columns)
