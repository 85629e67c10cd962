"""Merchant aliases and merchant ranking.

Aliases: merchant_id, merchant_name, ordinal (the merchants' order), alias_id,
alias_ordinal, pattern, match_mode (exact, tokenPrefix, contains), archived,
redirect_to. Archived and redirected merchants match nothing; one match counts for each
merchant, and the first merchant in order is a transaction's.

Descriptions are matched once each, and only by equal keys: whole text, leading tokens,
or a three-character gram that a contained pattern starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import dates, money, text
from coinbrook.operators.cashflow import small

GRAM = 3


def _prefixes(normalized: Column) -> Column:
    """"a", "a b", "a b c" of "a b c"."""
    words = F.split(normalized, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))


def _grams(normalized: Column) -> Column:
    """All distinct substrings of 1 to GRAM characters."""
    def of(n: int) -> Column:
        return F.when(F.length(normalized) >= n, F.transform(F.sequence(F.lit(1), F.length(normalized) - (n - 1)), lambda i: F.substring(normalized, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def alias_matches(descriptions: DataFrame, aliases: DataFrame) -> DataFrame:
    """description, normalized, merchant_id, merchant_name, ordinal, alias_id and match_mode: one row for each merchant that matches a distinct description."""
    d = descriptions.select("description").distinct().withColumn("normalized", text.normalize_merchant(F.col("description"))).filter("normalized <> ''")
    live = aliases.filter("not archived and redirect_to is null")
    pick = ["description", "normalized", "merchant_id", "merchant_name", "ordinal", "alias_id", "alias_ordinal", "match_mode"]
    exact = d.join(small(live.filter("match_mode = 'exact'")), F.col("normalized") == F.col("pattern")).select(*pick)
    prefix = d.withColumn("key", F.explode(_prefixes(F.col("normalized")))).join(small(live.filter("match_mode = 'tokenPrefix'")), F.col("key") == F.col("pattern")).select(*pick)
    inside = live.filter("match_mode = 'contains' and pattern <> ''").withColumn("key", F.substring("pattern", 1, GRAM))
    contains = d.withColumn("key", F.explode(_grams(F.col("normalized")))).join(small(inside), "key").filter(F.col("normalized").contains(F.col("pattern"))).select(*pick)
    found = exact.unionByName(prefix).unionByName(contains)
    first = F.min(F.struct("alias_ordinal", "alias_id", "match_mode")).alias("a")
    return found.groupBy("description", "normalized", "merchant_id", "merchant_name", "ordinal").agg(first).select("description", "normalized", "merchant_id", "merchant_name", "ordinal", "a.alias_id", "a.match_mode")


def first_merchant(matches: DataFrame) -> DataFrame:
    """The first matching merchant of each description, and how many match."""
    best = F.min(F.struct("ordinal", "merchant_id", "merchant_name")).alias("b")
    return matches.groupBy("description").agg(best, F.count("*").cast("long").alias("n_merchants")).select("description", F.col("b.merchant_id").alias("matched_id"), F.col("b.merchant_name").alias("matched_name"), "n_merchants")


def resolved(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with matched_id and matched_name by description, "unresolved" where nothing matches."""
    first = first_merchant(alias_matches(rows, aliases))
    out = rows.join(first, "description", "left")
    return out.withColumns({"matched_id": F.coalesce("matched_id", F.lit("unresolved")), "matched_name": F.coalesce("matched_name", F.lit("Unresolved Merchants"))})


def _outflows(rows: DataFrame, transfer_ids: DataFrame | None) -> DataFrame:
    out = rows.filter((F.col("status") == "posted") & money.is_outflow(F.col("amount")))
    return out.join(transfer_ids.select("txn_id"), "txn_id", "left_anti") if transfer_ids is not None else out


def monthly_trend(rows: DataFrame, aliases: DataFrame, transfer_ids: DataFrame | None = None) -> DataFrame:
    """Posted spending by currency, merchant and month. Equal descriptions are summed before they meet their merchant."""
    month = dates.month_key(F.col("posted_date"))
    summed = _outflows(rows, transfer_ids).groupBy("currency", "description", month.alias("month")).agg(money.total(-F.col("amount")).alias("s"), F.count("*").alias("n"))
    return resolved(summed, aliases).groupBy("currency", "matched_id", "matched_name", "month").agg(money.total(F.col("s")).alias("spending"), F.sum("n").cast("long").alias("n_transactions"))


def ranking(trend: DataFrame) -> DataFrame:
    """Total and count by currency and merchant; an order is up to the reader (spending descending, then name)."""
    return trend.groupBy("currency", "matched_id", "matched_name").agg(money.total(F.col("spending")).alias("spending"), F.sum("n_transactions").cast("long").alias("n_transactions"), F.count("*").cast("long").alias("n_months"))


def ranked(report: DataFrame) -> DataFrame:
    return report.orderBy("currency", F.desc("spending"), F.collate("matched_name", "UNICODE"))


def follow_redirects(merchants: DataFrame, limit: int = 40) -> DataFrame:
    """merchant_id and final_id behind all redirects; a merchant in or behind a cycle stays itself. Pointers double each round, so ``limit`` rounds end every chain; only the last round stays cached."""
    at, held = merchants.select("merchant_id", F.coalesce("redirect_to", "merchant_id").alias("final_id")), None
    for _ in range(limit):
        step = at.select(F.col("merchant_id").alias("final_id"), F.col("final_id").alias("next_id"))
        new = at.join(step, "final_id", "left").select("merchant_id", F.coalesce("next_id", "final_id").alias("new_id"), "final_id").persist()
        moved = new.filter("new_id <> final_id").count()
        if held is not None:
            held.unpersist()
        at, held = new.select("merchant_id", F.col("new_id").alias("final_id")), new
        if not moved:
            break
    ends = merchants.filter("redirect_to is null").select(F.col("merchant_id").alias("final_id"), F.lit(True).alias("is_end"))
    return at.join(ends, "final_id", "left").select("merchant_id", F.when(F.col("is_end"), F.col("final_id")).otherwise(F.col("merchant_id")).alias("final_id"))
