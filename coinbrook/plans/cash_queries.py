"""Filters, cash flow, savings, money flow, pages and exports."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.functions import money
from coinbrook.operators import cashflow, ledger
from coinbrook.plans import ledgers as L

#: name: (Spark form, SQL form)
QUERIES: dict = {}
D2, D38 = "DECIMAL(18,2)", "DECIMAL(38,2)"
WITH = f"WITH {L.LEDGER}, {L.CATEGORIES}, tagged AS (SELECT l.*, c.name AS category_name, coalesce(c.kind = 'transfer', FALSE) OR l.txn_id % 50 = 1 AS is_transfer, amount >= 0 AS is_inflow FROM ledger l LEFT JOIN categories c USING (category_id))"
_TOTAL = "CAST(coalesce(sum(CASE WHEN {0} THEN {1} END), 0) AS DECIMAL(38,2))"
SUMS = ", ".join(
    _TOTAL.format("status <> 'void' AND " + cond, value) + f" AS {name}"
    for name, cond, value in (("income", "NOT is_transfer AND is_inflow", "amount"), ("spending", "NOT is_transfer AND NOT is_inflow", "-amount"), ("transfers", "is_transfer", "abs(amount)"), ("net_cash_flow", "NOT is_transfer", "amount"))
)


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


def tagged(spark: SparkSession, sf_dir: str, flt=None) -> DataFrame:
    rows = L.ledger(spark, sf_dir)
    return cashflow.tagged(rows, L.categories(spark), L.linked_ids(rows), flt=flt)


RANGE = ledger.CashFlowFilter(since=date(1997, 2, 10), until=date(1998, 8, 20))


@register(f"{WITH} SELECT currency, {SUMS}, CAST(count(*) FILTER (status <> 'void') AS BIGINT) AS n_transactions, CAST(count(*) FILTER (status <> 'void' AND review_state = 'needsReview') AS BIGINT) AS n_unresolved, CAST(count(*) FILTER (status = 'void') AS BIGINT) AS n_void FROM tagged GROUP BY currency")
def cash_flow_by_currency(spark, sf_dir):
    return cashflow.by_currency(tagged(spark, sf_dir))


_MONTH = "strftime(posted_date, '%Y-%m')"


@register(f"{WITH} SELECT currency, {_MONTH} AS month, {SUMS}, DATE '1998-07-15' < last_day(max(posted_date)) AS incomplete FROM tagged WHERE status <> 'void' GROUP BY currency, {_MONTH}")
def cash_flow_by_month(spark, sf_dir):
    return cashflow.by_month(tagged(spark, sf_dir), L.AS_OF)


@register(f"{WITH} SELECT currency, {_MONTH} AS month, {SUMS}, DATE '1998-07-15' < last_day(max(posted_date)) OR DATE '1997-02-10' > date_trunc('month', max(posted_date)) OR DATE '1998-08-20' < last_day(max(posted_date)) AS incomplete FROM tagged WHERE status <> 'void' AND posted_date BETWEEN DATE '1997-02-10' AND DATE '1998-08-20' GROUP BY currency, {_MONTH}")
def incomplete_months(spark, sf_dir):
    return cashflow.by_month(tagged(spark, sf_dir, RANGE), L.AS_OF, RANGE)


@register(f"{WITH} SELECT currency, account_id, {SUMS} FROM tagged WHERE status <> 'void' GROUP BY currency, account_id")
def cash_flow_by_account(spark, sf_dir):
    return cashflow.by_account(tagged(spark, sf_dir))


_BY_CATEGORY = "SELECT currency, coalesce(category_id, 'uncategorized') AS category_key, coalesce(max(category_name), 'Uncategorized') AS category_name, CAST(sum(-amount) AS DECIMAL(38,2)) AS spending, CAST(count(*) AS BIGINT) AS n_transactions FROM tagged WHERE status <> 'void' AND NOT is_transfer AND NOT is_inflow GROUP BY ALL"


@register(f"{WITH} {_BY_CATEGORY}")
def spending_by_category(spark, sf_dir):
    return cashflow.spending_by_category(tagged(spark, sf_dir))


@register(f"{WITH} SELECT currency, CAST(count(*) FILTER (status <> 'void' AND review_state = 'needsReview') AS BIGINT) AS n_unresolved, CAST(count(*) FILTER (status = 'void') AS BIGINT) AS n_void FROM tagged GROUP BY currency")
def disclosure_counts(spark, sf_dir):
    return cashflow.by_currency(tagged(spark, sf_dir)).select("currency", "n_unresolved", "n_void")


def _ratio_sql(part: str, whole: str, digits: int, factor: int = 1) -> str:
    """Half up in whole numbers."""
    p, w, scale = f"CAST(abs({part}) * 100 AS HUGEINT)", f"CAST({whole} * 100 AS HUGEINT)", 10**digits * factor
    unit = f"CAST('0.{'0' * (digits - 1)}1' AS DECIMAL({digits + 1},{digits}))"
    return f"CASE WHEN {whole} <> 0 THEN CAST(CAST(sign({part}) * ((2 * {scale} * {p} + {w}) // (2 * {w})) AS DECIMAL(17,0)) * {unit} AS DECIMAL(18,{digits})) END"


_RATE = _ratio_sql("net_cash_flow", "income", 4)


@register(f"{WITH}, r AS (SELECT currency, {SUMS} FROM tagged GROUP BY currency) SELECT currency, income, net_cash_flow, {_RATE} AS rate, CASE WHEN income = 0 THEN 'notApplicable' ELSE 'normal' END AS rate_status FROM r")
def savings_rate(spark, sf_dir):
    return cashflow.savings_rate(cashflow.by_currency(tagged(spark, sf_dir))).select("currency", "income", "net_cash_flow", "rate", "rate_status")


@register(f"{WITH}, r AS (SELECT currency, {_MONTH} AS month, {SUMS}, DATE '1998-07-15' < last_day(max(posted_date)) AS incomplete FROM tagged WHERE status <> 'void' GROUP BY currency, {_MONTH}) SELECT currency, month, {_RATE} AS rate, CASE WHEN income = 0 THEN 'notApplicable' WHEN incomplete THEN 'incomplete' ELSE 'normal' END AS rate_status FROM r")
def savings_rate_by_month(spark, sf_dir):
    return cashflow.savings_rate(cashflow.by_month(tagged(spark, sf_dir), L.AS_OF)).select("currency", "month", "rate", "rate_status")


@register(
    f"{WITH}, c AS (SELECT currency, {SUMS} FROM tagged GROUP BY currency), k AS ({_BY_CATEGORY}) SELECT k.currency, 'income' AS source, 'category:' || category_key AS target, k.spending AS amount, CAST({_ratio_sql('k.spending', 'c.spending', 1, 100)} AS VARCHAR) || '%' AS share FROM k JOIN c USING (currency) UNION ALL SELECT currency, 'income', 'transfers', transfers, 'N/A (Internal)' FROM c WHERE transfers > 0"
)
def money_flow_edges(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    return cashflow.money_flow(cashflow.by_currency(rows), cashflow.spending_by_category(rows))


@register(
    f"{WITH} SELECT currency, CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(account_id) = 0 THEN 'account' WHEN grouping(category_key) = 0 THEN 'category' ELSE 'currency' END AS level, coalesce(month, CAST(account_id AS VARCHAR), category_key) AS key, {SUMS} FROM (SELECT *, {_MONTH} AS month, coalesce(category_id, 'uncategorized') AS category_key FROM tagged WHERE status <> 'void') GROUP BY GROUPING SETS ((currency), (currency, month), (currency, account_id), (currency, category_key))"
)
def cash_flow_all_levels(spark, sf_dir):
    out = cashflow.all_levels(tagged(spark, sf_dir))
    level = F.when(F.col("month").isNotNull(), "month").when(F.col("account_id").isNotNull(), "account").when(F.col("category_key").isNotNull(), "category").otherwise("currency")
    return out.select("currency", level.alias("level"), F.coalesce("month", F.col("account_id").cast("string"), "category_key").alias("key"), "income", "spending", "transfers", "net_cash_flow")


@register(f"{WITH} SELECT currency, coalesce(merchant_id, 'none') AS dimension, {_TOTAL.format('NOT is_transfer AND NOT is_inflow', '-amount')} AS value FROM tagged WHERE status <> 'void' GROUP BY ALL")
def metric_spending_by_merchant(spark, sf_dir):
    return cashflow.metric_by(tagged(spark, sf_dir), "spending", "merchant").withColumn("dimension", F.coalesce("dimension", F.lit("none")))


def _filter(name: str, sql_condition: str, condition):
    def run(spark, sf_dir):
        return L.ledger(spark, sf_dir).filter(condition.condition()).select("txn_id", "posted_date", "amount", "currency", "status")

    run.__name__ = name
    register(f"WITH {L.LEDGER} SELECT txn_id, posted_date, amount, currency, status FROM ledger WHERE {sql_condition}")(run)


C, V = ledger.CashFlowFilter, ledger.LedgerFilter
_filter("filter_accounts_dates", "account_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND posted_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", C(account_ids=(1, 2, 3, 5, 8, 13, 21, 34), since=date(1996, 1, 1), until=date(1999, 12, 31)))
_filter("filter_status", "status IN ('pending', 'void')", V(statuses=("pending", "void")))
_filter("filter_category_null", "category_id IN ('2-HIGH')", C(category_ids=("2-HIGH",)))
_filter("filter_uncategorized", "category_id IS NULL OR category_id = '3-MEDIUM'", V(uncategorized=True, category_ids=("3-MEDIUM",)))
_filter("filter_tags_any", "list_has_any(tags, ['home', 'food'])", C(tags=("home", " food ")))
_filter("filter_tags_all", "list_has_all(list_transform(tags, lambda t: lower(t)), ['home', 'food'])", V(tags=("HOME", "Food")))
_filter("filter_search", "contains(lower(concat_ws(' ', description, notes, array_to_string(tags, ' '))), 'furniture 2-high #1')", V(search=" FURNITURE 2-High #1"))
_filter("filter_search_notes", "contains(lower(concat_ws(' ', description, notes, array_to_string(tags, ' '))), 'note 7')", V(search="Note 7"))
_filter("filter_amount_range", "currency = 'EUR' AND amount >= -20000.50 AND amount <= 1000", V(currencies=("EUR",), minimum=Decimal("-20000.50"), maximum=Decimal(1000)))
_filter("filter_direction_zero_is_inflow", "amount >= 0", V(directions=("inflow", "zero")))
_filter("filter_direction_zero_is_empty", "FALSE", V(directions=("zero",)))
_filter("filter_merchants_review", "merchant_id IN ('m1', 'm2') AND review_state IN ('needsReview', 'reviewed')", C(merchant_ids=("m1", "m2"), review_states=("needsReview", "reviewed")))
_filter("filter_empty_list", "FALSE", C(currencies=()))


@register(f"WITH {L.LEDGER} SELECT txn_id, posted_date, amount, description FROM ledger ORDER BY posted_date DESC, txn_id DESC LIMIT 100")
def ledger_page_default(spark, sf_dir):
    return ledger.page(L.ledger(spark, sf_dir))[0].select("txn_id", "posted_date", "amount", "description")


@register(f"WITH {L.LEDGER} SELECT txn_id, currency, amount FROM ledger WHERE status = 'posted' ORDER BY currency, amount, txn_id LIMIT 50 OFFSET 25")
def ledger_sort_amount(spark, sf_dir):
    return ledger.page(L.ledger(spark, sf_dir), V(statuses=("posted",)), "amount", False, 25, 50)[0].select("txn_id", "currency", "amount")


@register(f"WITH {L.LEDGER} SELECT txn_id, review_state FROM ledger ORDER BY review_state DESC, txn_id DESC LIMIT 40")
def ledger_sort_review_state(spark, sf_dir):
    return ledger.page(L.ledger(spark, sf_dir), sort="review_state", limit=40)[0].select("txn_id", "review_state")


@register(f"WITH {L.LEDGER} SELECT CAST(count(*) AS BIGINT) AS total FROM ledger WHERE contains(lower(concat_ws(' ', description, notes, array_to_string(tags, ' '))), 'building')")
def ledger_total(spark, sf_dir):
    return ledger.page(L.ledger(spark, sf_dir), V(search="building"))[1]


_PLAIN = "CASE WHEN contains(CAST(amount AS VARCHAR), '.') THEN regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '0+$', ''), '\\.$', '') ELSE CAST(amount AS VARCHAR) END"
_ACCOUNTS = "accounts AS (SELECT c_custkey AS account_id, c_name AS name FROM customer WHERE c_custkey % 10 <> 0)"


@register(
    f"""WITH {L.LEDGER}, {L.CATEGORIES}, {_ACCOUNTS} SELECT CAST(txn_id AS VARCHAR) AS transaction_id, CAST(posted_date AS VARCHAR) AS posted_date, coalesce(a.name, 'Unknown account') AS account, description, {_PLAIN} AS amount, currency,
  CASE WHEN l.category_id IS NULL THEN 'Uncategorized' ELSE coalesce(c.name, 'Unknown category') END AS category, status, review_state, array_to_string(tags, ';') AS tags, 'all' AS filter FROM ledger l LEFT JOIN accounts a USING (account_id) LEFT JOIN categories c ON c.category_id = l.category_id"""
)
def export_projection(spark, sf_dir):
    return ledger.export_projection(L.ledger(spark, sf_dir), L.accounts(spark, sf_dir), L.categories(spark), "all")


@register(f"WITH {L.LEDGER} SELECT txn_id, {_PLAIN} AS rendered FROM ledger")
def amount_render(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("txn_id", money.render(F.col("amount")).alias("rendered"))


@register(f"WITH {L.LEDGER} SELECT DISTINCT txn_id, {_MONTH} AS month FROM ledger")
def month_key(spark, sf_dir):
    from coinbrook.functions.dates import month_key as key

    return L.ledger(spark, sf_dir).select("txn_id", key(F.col("posted_date")).alias("month"))


_WANTED = "wanted AS (SELECT txn_id FROM ledger WHERE txn_id % 20 = 0 UNION SELECT -1)"


@register(
    f"WITH {L.LEDGER}, {_WANTED}, s AS (SELECT w.txn_id, l.txn_id IS NOT NULL AS found, l.txn_id IS NOT NULL AND (category_id IS DISTINCT FROM '2-HIGH' OR review_state <> 'reviewed') AS changed FROM wanted w LEFT JOIN ledger l USING (txn_id)) SELECT CAST(count(*) AS BIGINT) AS selected, CAST(count(*) FILTER (changed) AS BIGINT) AS affected, CAST(count(*) FILTER (found AND NOT changed) AS BIGINT) AS unchanged, CAST(count(*) FILTER (NOT found) AS BIGINT) AS missing FROM s"
)
def bulk_edit_preview(spark, sf_dir):
    rows = L.ledger(spark, sf_dir)
    ids = rows.filter("txn_id % 20 = 0").select("txn_id").unionByName(spark.createDataFrame([(-1,), (-1,)], "txn_id long"))
    return ledger.bulk_edit_preview(rows, ids, ledger.Edit(category_id="2-HIGH", merchant_id="m9", review_state="reviewed"))


@register(f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN amount >= 0 THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS inflow, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DECIMAL(38,2)) AS outflow, CAST(sum(amount) AS DECIMAL(38,2)) AS net, CAST(count(DISTINCT currency) AS BIGINT) AS currencies, CAST(count(DISTINCT account_id) AS BIGINT) AS accounts FROM tagged")
def workload_reconciliation(spark, sf_dir):
    rows, a = L.ledger(spark, sf_dir), F.col("amount")
    return rows.agg(F.count("*").alias("n"), money.total(a, a >= 0).alias("inflow"), money.total(-a, a < 0).alias("outflow"), money.total(a).alias("net"), F.count_distinct("currency").alias("currencies"), F.count_distinct("account_id").alias("accounts"))
