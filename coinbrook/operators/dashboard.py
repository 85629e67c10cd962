"""The dashboard: one filtered ledger and the reports that share it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.operators import cashflow, merchants, recurring
from coinbrook.operators.ledger import CashFlowFilter, apply_filter


@dataclass(frozen=True)
class Inputs:
    """Tables of one revision. links: signature, outflow_id, inflow_id, status. decisions: signature, ordinal, status; decision_members: signature, txn_id of members stored on decisions."""

    ledger: DataFrame
    categories: DataFrame
    aliases: DataFrame
    links: DataFrame
    decisions: DataFrame
    decision_members: DataFrame | None = None


def recurring_member_ids(inputs: Inputs, statuses: tuple[str, ...], linked: DataFrame) -> DataFrame:
    """txn_id of the members of series with one of ``statuses``: of proposals by their decision, and those that decisions themselves hold."""
    found = recurring.proposals(inputs.ledger, linked)
    chosen = recurring.with_status(found, inputs.decisions).filter(F.col("status").isin(*statuses))
    ids = recurring.members(inputs.ledger, chosen, linked).select("txn_id")
    if inputs.decision_members is not None:
        wanted = recurring.latest(inputs.decisions).filter(F.col("decided").isin(*statuses)).select("signature")
        ids = ids.unionByName(inputs.decision_members.join(wanted, "signature", "left_semi").select("txn_id"))
    return ids.distinct()


def dashboard(inputs: Inputs, as_of: date, flt: CashFlowFilter | None = None, recurring_statuses: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Reports by name. ``recurring_statuses`` keeps only members of such series (none given: all rows); series are detected again on what the filter keeps."""
    from coinbrook.operators.transfers import confirmed_ids

    linked = confirmed_ids(inputs.links)
    kept = apply_filter(inputs.ledger, flt)
    if recurring_statuses:
        kept = kept.join(recurring_member_ids(inputs, recurring_statuses, linked), "txn_id", "left_semi")
    rows = cashflow.tagged(kept, inputs.categories, linked)
    by_currency, by_category = cashflow.by_currency(rows), cashflow.spending_by_category(rows)
    by_month = cashflow.by_month(rows, as_of, flt)
    found = recurring.proposals(kept, linked)
    trend = merchants.monthly_trend(kept, inputs.aliases, linked)
    return {
        "cash_flow": by_currency,
        "months": by_month,
        "accounts": cashflow.by_account(rows),
        "categories": by_category,
        "savings": cashflow.savings_rate(by_currency),
        "savings_by_month": cashflow.savings_rate(by_month),
        "money_flow": cashflow.money_flow(by_currency, by_category),
        "merchants": merchants.ranking(trend),
        "merchant_months": trend,
        "recurring": recurring.summary(found, inputs.decisions),
    }


def group_members(rows: DataFrame, *key: str) -> DataFrame:
    """The ids behind a report's groups, one row each, with the kind of flow they count as. Reports keep no lists: a group may hold any share of the ledger."""
    kind = F.when(F.col("is_transfer"), "transfer").when(F.col("is_inflow"), "income").otherwise("spending")
    return rows.filter("status <> 'void'").select(*key, kind.alias("flow"), "txn_id")


def takeaways(currencies: DataFrame) -> DataFrame:
    """One sentence for each currency."""
    from coinbrook.functions.money import render

    net = F.col("net_cash_flow")
    apart = F.concat(F.when(net > 0, "Income exceeds spending by ").otherwise("Spending exceeds income by "), "currency", F.lit(" "), render(F.abs(net)), F.lit("."))
    balanced = F.concat(F.lit("Income and spending are balanced at "), "currency", F.lit(" 0."))
    return currencies.select("currency", F.when(net == 0, balanced).otherwise(apart).alias("takeaway"))
