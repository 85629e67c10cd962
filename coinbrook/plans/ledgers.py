"""Ledgers made from the star-schema tables, in Spark and as common table expressions for SQL."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.operators.rules import Condition, Rule

AS_OF = date(1998, 7, 15)

_CURRENCY = "CASE r_name WHEN 'AFRICA' THEN 'ZAR' WHEN 'AMERICA' THEN 'USD' WHEN 'ASIA' THEN 'JPY' WHEN 'EUROPE' THEN 'EUR' ELSE 'AED' END"
_STATUS = "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'void' WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'pending' ELSE 'posted' END"
_CATEGORY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'transfer' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END"
_REVIEW = "CASE o_orderkey % 6 WHEN 0 THEN 'needsReview' WHEN 1 THEN 'reviewed' ELSE 'unreviewed' END"
_MERCHANT = "CASE WHEN o_orderkey % 11 <> 0 THEN concat('m', o_custkey % 40) END"
_DESCRIPTION = "concat(CASE o_orderkey % 4 WHEN 0 THEN 'SQ *' WHEN 1 THEN 'PAYPAL * ' WHEN 2 THEN 'POS ' ELSE '' END, c_mktsegment, ' ', o_orderpriority, ' #', o_orderkey % 97)"
_NOTES = "CASE WHEN o_orderkey % 9 = 0 THEN concat('note ', o_orderkey % 100) END"
_AMOUNT = "CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2))"

LEDGER = f"""ledger AS (SELECT o_orderkey AS txn_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS posted_date, {_AMOUNT} AS amount, {_CURRENCY} AS currency,
  {_STATUS} AS status, {_CATEGORY} AS category_id, {_REVIEW} AS review_state, {_MERCHANT} AS merchant_id, {_DESCRIPTION} AS description, {_NOTES} AS notes,
  CASE o_orderkey % 3 WHEN 0 THEN ['Home', 'food'] WHEN 1 THEN ['home'] ELSE [] END AS tags
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

CATEGORY_ROWS = [("transfer", "Transfers", "transfer"), ("2-HIGH", "Groceries", "expense"), ("3-MEDIUM", "Dining", "expense")]
CATEGORIES = "categories AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CATEGORY_ROWS) + ") AS t(category_id, name, kind))"

ITEMS = """items AS (SELECT CAST(l_shipdate AS DATE) AS posted_date, -CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, 'USD' AS currency, CASE WHEN l_linestatus = 'O' AND l_linenumber = 4 THEN 'pending' ELSE 'posted' END AS status,
  concat(p_name, ' ', translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS description FROM lineitem JOIN part ON p_partkey = l_partkey)"""

#: merchant, name, ordinal, alias, alias ordinal, pattern, mode, archived, redirect
ALIAS_ROWS = [
    ("m1", "Automobile Club", 1, "a1", 1, "automobile", "tokenPrefix", False, None),
    ("m1", "Automobile Club", 1, "a2", 2, "automobile 2 high", "exact", False, None),
    ("m2", "Urgent Care", 2, "a3", 1, "urgent", "contains", False, None),
    ("m3", "Builders", 3, "a4", 1, "building", "tokenPrefix", False, None),
    ("m4", "Old Shop", 4, "a5", 1, "machinery", "tokenPrefix", True, None),
    ("m5", "Moved Shop", 5, "a6", 1, "furniture", "tokenPrefix", False, "m3"),
    ("m6", "Households", 6, "a7", 1, "household 5 low", "exact", False, None),
    ("m7", "Medium", 7, "a8", 1, "medi", "contains", False, None),
]
ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}', {e}, '{p}', '{m}', {str(x).lower()}, {repr(r) if r else 'NULL'})" for a, b, c, d, e, p, m, x, r in ALIAS_ROWS) + ") AS t(merchant_id, merchant_name, ordinal, alias_id, alias_ordinal, pattern, match_mode, archived, redirect_to))"

RULES = [
    Rule("r1", "small", 10, (Condition("amount", "inRange", minimum="0", maximum="50000"),), set_category="small"),
    Rule("r2", "cars", 10, (Condition("normalizedDescription", "startsWith", "automobile"),), set_category="cars"),
    Rule("r3", "income", 20, (Condition("direction", "equals", "inflow"), Condition("tag", "equals", "home")), set_category="income", set_merchant="payer"),
    Rule("r4", "urgent", 5, (Condition("normalizedDescription", "contains", "urgent"),), set_merchant="urgency"),
    Rule("r5", "off", 99, (Condition("direction", "equals", "outflow"),), set_category="never", enabled=False),
    Rule("r6", "large", 10, (Condition("amount", "inRange", minimum="40000", maximum="400000"),), set_category="large"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger. Nations and regions are fixed tables of a few rows, so that no order is dealt by its nation; customers are joined as they come."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(places), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("posted_date"),
        *[F.expr(e).alias(n) for n, e in (("amount", _AMOUNT), ("currency", _CURRENCY), ("status", _STATUS), ("category_id", _CATEGORY), ("review_state", _REVIEW), ("merchant_id", _MERCHANT), ("description", _DESCRIPTION), ("notes", _NOTES))],
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Home"), F.lit("food"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("home"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as outflows with repeating descriptions, made once a part. They have no key of their own; txn_id is null."""
    letters = F.translate(F.col("p_partkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), letters).alias("description"))
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(
        F.lit(None).cast("long").alias("txn_id"),
        F.to_date("l_shipdate").alias("posted_date"),
        (-F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 4), "pending").otherwise("posted").alias("status"),
        "description",
    )


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_ROWS, "category_id string, name string, kind string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIAS_ROWS, "merchant_id string, merchant_name string, ordinal int, alias_id string, alias_ordinal int, pattern string, match_mode string, archived boolean, redirect_to string")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine in ten customers as accounts; the others are unknown."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "savings").otherwise("checking").alias("account_type"))


def linked_ids(rows: DataFrame) -> DataFrame:
    """A stated set of confirmed transfers."""
    return rows.filter("txn_id % 50 = 1").select("txn_id")


CENT = Decimal("0.01")
