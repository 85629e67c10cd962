"""Commands on accounts, categories, merchants, rules and decisions, as tables in and tables out.

A command returns the new table; what may not happen is a row of ``problems`` functions, or
an error where the driver alone can tell. Nothing is written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import text

#: Kinds of account, kinds of category, and the categories of a new workspace.
ACCOUNT_TYPES = ("checking", "savings", "creditCard", "cash", "investment", "loan", "other")
CATEGORY_KINDS = ("income", "expense", "transfer", "investment")
STARTERS = ("Income", "Housing", "Groceries", "Dining", "Transport", "Utilities", "Health", "Entertainment", "Shopping", "Transfers", "Other")
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def is_uuid(value: Column) -> Column:
    return F.lower(value).rlike(UUID)


def account_problems(accounts: DataFrame) -> DataFrame:
    """account_id and problem of accounts that break a limit."""
    checks = {
        "name": F.length(F.trim("name")).between(1, 120),
        "type": F.col("account_type").isin(*ACCOUNT_TYPES),
        "currency": F.col("currency").rlike("^[A-Z]{3}$"),
        "masked_identifier": F.col("masked_identifier").isNull() | (F.length("masked_identifier") <= 32) & ~F.col("masked_identifier").rlike("[0-9]{5,}"),
    }
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda x: x.isNotNull())
    return accounts.select("account_id", F.explode(found).alias("problem"))


def change_currency(accounts: DataFrame, ledger: DataFrame, account_id, currency: str) -> DataFrame:
    """The accounts with a new currency for one that has no transactions yet; others stay."""
    used = ledger.filter(F.col("account_id") == account_id).limit(1).select("account_id", F.lit(True).alias("used"))
    out = accounts.join(F.broadcast(used), "account_id", "left")  # one row at most
    hit = (F.col("account_id") == account_id) & F.col("used").isNull()
    return out.withColumn("currency", F.when(hit, currency).otherwise(F.col("currency"))).select(*accounts.columns)


def set_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    """Rename, archive and the like: ``values`` where the condition holds."""
    return table.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def seeded_categories(categories: DataFrame) -> DataFrame:
    """The starter categories for an empty table, else the table."""
    spark = categories.sparkSession
    if not categories.isEmpty():
        return categories
    kinds = {"Income": "income", "Transfers": "transfer"}
    rows = [(f"starter-{i:02d}", name, kinds.get(name, "expense"), i) for i, name in enumerate(STARTERS, 1)]
    return spark.createDataFrame(rows, "category_id string, name string, kind string, position int")


def new_alias(merchant_id: str, pattern: Column, mode: str = "tokenPrefix") -> list[Column]:
    """Columns of an alias; a pattern is normalized as descriptions are."""
    return [F.lit(merchant_id).alias("merchant_id"), text.normalize_merchant(pattern).alias("pattern"), F.lit(mode).alias("match_mode")]


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (merchant_id, pattern, match_mode) with the new ones that are neither there nor empty."""
    key = ["merchant_id", "pattern", "match_mode"]
    fresh = new.filter(F.length("pattern").between(1, 240)).select(*key).distinct().join(aliases.select(*key), key, "left_anti")
    return aliases.select(*key).unionByName(fresh)


def merge_merchants(merchants: DataFrame, aliases: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The source archived and redirected, and its aliases, each pattern and mode once, added to the target's."""
    if source == target:
        raise ValueError("a merchant can't be merged with itself")
    hit = F.col("merchant_id") == source
    m = merchants.withColumns({"archived": F.col("archived") | hit, "redirect_to": F.when(hit, F.lit(target)).otherwise(F.col("redirect_to"))})
    moved = aliases.filter(hit).withColumn("merchant_id", F.lit(target))
    return m, add_aliases(aliases, moved)


def unmerge_merchant(merchants: DataFrame, source: str) -> DataFrame:
    """The source live again; aliases that the target got stay."""
    hit = (F.col("merchant_id") == source) & F.col("redirect_to").isNotNull()
    return merchants.withColumns({"archived": F.col("archived") & ~hit, "redirect_to": F.when(~hit, F.col("redirect_to"))})


def decide_recurring(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """The log of decisions with ``changes`` (signature, status, tolerance_days) added behind it; only known statuses and tolerances of 0 to 31 days."""
    last = decisions.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("last")).first()["last"]
    ok = changes.filter(F.col("status").isin("confirmed", "dismissed", "muted", "superseded", "invalidated") & F.col("tolerance_days").between(0, 31))
    added = ok.withColumn("ordinal", F.lit(last + 1))
    return decisions.unionByName(added.select(*decisions.columns), allowMissingColumns=True)


def invalidate_on_void(decisions: DataFrame, decision_members: DataFrame, voided: DataFrame) -> DataFrame:
    """Confirmed decisions with a voided member are invalidated; an undo of the void does not bring them back."""
    hit = decision_members.join(voided.select("txn_id"), "txn_id", "left_semi").select("signature").distinct().withColumn("hit", F.lit(True))
    out = decisions.join(hit, "signature", "left")
    return out.withColumn("status", F.when(F.col("hit") & (F.col("status") == "confirmed"), "invalidated").otherwise(F.col("status"))).select(*decisions.columns)


def apply_operation(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` after journaled changes (key, before, after: structs of the other columns): a change whose before is not what the table holds raises, so nothing is overwritten unseen."""
    columns = [c for c in table.columns if c != key]
    joined = table.join(changes.select(key, "before", "after"), key, "left")
    now = F.to_json(F.struct(*columns))
    stale = F.col("after").isNotNull() & (now != F.to_json("before"))
    pick = lambda c: F.when(stale, F.raise_error(F.concat(F.lit("changed meanwhile: "), F.col(key).cast("string")))).when(F.col("after").isNotNull(), F.col(f"after.{c}")).otherwise(F.col(c))
    return joined.select(key, *[pick(c).cast(table.schema[c].dataType).alias(c) for c in columns]).select(*table.columns)


def undo_operation(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The reverse of ``apply_operation``."""
    return apply_operation(table, changes.select(key, F.col("after").alias("before"), F.col("before").alias("after")), key)


def automatic_edit(ledger: DataFrame, proposals: DataFrame, field: str) -> DataFrame:
    """Proposed values (txn_id, value) written to category_id or merchant_id where the row's own lock is off."""
    lock = f"{field.removesuffix('_id')}_locked"
    joined = ledger.join(proposals.select("txn_id", "value"), "txn_id", "left")
    free = F.col("value").isNotNull() & ~F.coalesce(lock, F.lit(False))
    return joined.withColumn(field, F.when(free, F.col("value")).otherwise(F.col(field))).select(*ledger.columns)


def imports_of(imports: DataFrame, account_id) -> DataFrame:
    return imports.filter(F.col("account_id") == account_id).orderBy("created_at")
