"""Cash flow, savings rate and money flow: conditional sums over one tagged ledger.

Voids never count. A transfer is a row with a linked id or with a category of kind
transfer; zero is an inflow. Currencies are never mixed. Each report is one grouped
pass, partially summed before its shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import dates, money
from coinbrook.operators.ledger import CashFlowFilter, apply_filter

#: Categories and links of one workspace are looked up by broadcast only below this many rows; beyond it they are shuffled.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted size is below BROADCAST_ROWS."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tagged(ledger: DataFrame, categories: DataFrame, transfer_ids: DataFrame | None = None, by_category: bool = True, flt: CashFlowFilter | None = None) -> DataFrame:
    """The filtered ledger with is_transfer, is_inflow, category_name and category_known. ``transfer_ids`` (txn_id) are confirmed links; without ``by_category`` only they make transfers."""
    rows = apply_filter(ledger, flt)
    known = categories.select("category_id", F.col("name").alias("category_name"), F.col("kind").alias("category_kind"))
    rows = rows.join(small(known), "category_id", "left")
    linked: Column = F.lit(False)
    if transfer_ids is not None:
        rows = rows.join(transfer_ids.select("txn_id").distinct().withColumn("linked", F.lit(True)), "txn_id", "left")
        linked = F.coalesce("linked", F.lit(False))
    kind = F.coalesce(F.col("category_kind") == "transfer", F.lit(False)) if by_category else F.lit(False)
    return rows.withColumns({"is_transfer": linked | kind, "is_inflow": money.is_inflow(F.col("amount"))}).drop("linked")


def sums() -> list[Column]:
    """income, spending, transfers and net_cash_flow of the rows that are not void."""
    live, a = F.col("status") != "void", F.col("amount")
    income, spending = live & ~F.col("is_transfer") & F.col("is_inflow"), live & ~F.col("is_transfer") & ~F.col("is_inflow")
    return [
        money.total(a, income).alias("income"),
        money.total(-a, spending).alias("spending"),
        money.total(F.abs(a), live & F.col("is_transfer")).alias("transfers"),
        money.total(a, live & ~F.col("is_transfer")).alias("net_cash_flow"),
    ]


def by_currency(rows: DataFrame) -> DataFrame:
    """A row for each currency of the filtered rows, also where all are void, with the disclosure counts."""
    live = F.col("status") != "void"
    return rows.groupBy("currency").agg(
        *sums(),
        money.count_if(live).alias("n_transactions"),
        money.count_if(live & (F.col("review_state") == "needsReview")).alias("n_unresolved"),
        money.count_if(~live).alias("n_void"),
    )


def by_month(rows: DataFrame, as_of: date, flt: CashFlowFilter | None = None) -> DataFrame:
    first = F.trunc("posted_date", "month")
    flt = flt or CashFlowFilter()
    return rows.filter("status <> 'void'").groupBy("currency", first.alias("first")).agg(*sums()).select("currency", dates.month_key(F.col("first")).alias("month"), "income", "spending", "transfers", "net_cash_flow", dates.incomplete_month(F.col("first"), as_of, flt.since, flt.until).alias("incomplete"))


def by_account(rows: DataFrame) -> DataFrame:
    return rows.filter("status <> 'void'").groupBy("currency", "account_id").agg(*sums())


def spending_by_category(rows: DataFrame) -> DataFrame:
    """Spending that is no transfer; no category is "uncategorized", unknown ids keep rows of their own under the name Uncategorized."""
    spent = rows.filter((F.col("status") != "void") & ~F.col("is_transfer") & ~F.col("is_inflow"))
    key = F.coalesce("category_id", F.lit("uncategorized"))
    return spent.groupBy("currency", key.alias("category_key")).agg(F.max("category_name").alias("n"), money.total(-F.col("amount")).alias("spending"), F.count("*").cast("long").alias("n_transactions")).select("currency", "category_key", F.coalesce("n", F.lit("Uncategorized")).alias("category_name"), "spending", "n_transactions")


def all_levels(rows: DataFrame) -> DataFrame:
    """Currency, month, account and category levels in one pass (an extension: grouping sets)."""
    r = rows.filter("status <> 'void'").withColumns({"month": dates.month_key(F.col("posted_date")), "category_key": F.coalesce("category_id", F.lit("uncategorized"))})
    level = F.grouping_id().alias("level")
    return r.groupingSets([["currency"], ["currency", "month"], ["currency", "account_id"], ["currency", "category_key"]], "currency", "month", "account_id", "category_key").agg(level, *sums())


def savings_rate(report: DataFrame) -> DataFrame:
    """rate (net / income, four places) and rate_status of each row of a cash-flow report; months that are incomplete say so."""
    rate = money.ratio(F.col("net_cash_flow"), F.col("income"), 4)
    status = F.when(F.col("income") == 0, "notApplicable")
    if "incomplete" in report.columns:
        status = status.when(F.col("incomplete"), "incomplete")
    return report.withColumns({"rate": rate, "rate_status": status.otherwise("normal")})


def money_flow(currencies: DataFrame, categories: DataFrame) -> DataFrame:
    """Edges from income to each category with its share of all spending, and one for transfers where there are any."""
    spent = categories.join(currencies.select("currency", F.col("spending").alias("total")), "currency")
    edges = spent.select("currency", F.lit("income").alias("source"), F.concat(F.lit("category:"), "category_key").alias("target"), F.col("spending").alias("amount"), F.concat(money.percentage(F.col("spending"), F.col("total")).cast("string"), F.lit("%")).alias("share"))
    moved = currencies.filter("transfers > 0").select("currency", F.lit("income").alias("source"), F.lit("transfers").alias("target"), F.col("transfers").alias("amount"), F.lit("N/A (Internal)").alias("share"))
    return edges.unionByName(moved)


#: The metrics and dimensions of the small report query below.
METRICS = {"income": "income", "spending": "spending", "netCashFlow": "net_cash_flow"}
DIMENSIONS = {
    "month": dates.month_key,
    "day": lambda d: d.cast("string"),
}


def metric_by(rows: DataFrame, metric: str, dimension: str, limit: int | None = None) -> DataFrame:
    """An extension: one metric by month, day, category, merchant or account, largest first if limited."""
    keys = {"category": F.coalesce("category_id", F.lit("uncategorized")), "merchant": F.col("merchant_id"), "account": F.col("account_id").cast("string")}
    key = keys[dimension] if dimension in keys else DIMENSIONS[dimension](F.col("posted_date"))
    live = rows.filter("status <> 'void'").groupBy("currency", key.alias("dimension"))
    if metric == "transactionCount":
        out = live.agg(F.count("*").cast("long").alias("value"))
    elif metric == "savingsRate":
        out = savings_rate(live.agg(*sums())).select("currency", "dimension", F.col("rate").alias("value"))
    else:
        out = live.agg(*sums()).select("currency", "dimension", F.col(METRICS[metric]).alias("value"))
    return out.orderBy(F.desc("value"), "dimension").limit(limit) if limit else out
