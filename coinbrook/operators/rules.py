"""Classification rules: conditions compiled to columns, tiers, results, review queue.

A rule holds if all its conditions do. Rules are plain values on the driver (a workspace
has some thousands at most); they are compiled to one array expression, so a ledger of any
size is classified in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import money, text

#: Operators that each field allows, and what each operator adds to a rule's specificity.
OPERATORS = {
    "normalizedDescription": ("equals", "contains", "startsWith"),
    "merchantId": ("equals",),
    "accountId": ("equals",),
    "accountType": ("equals",),
    "postedDate": ("equals",),
    "direction": ("equals",),
    "amount": ("equals", "inRange"),
    "categoryId": ("equals",),
    "tag": ("equals", "contains"),
}
SPECIFICITY = {"equals": 10, "startsWith": 5, "inRange": 5, "contains": 2}
MAX_RULES = 10_000


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str | None = None
    minimum: str | None = None
    maximum: str | None = None

    def __post_init__(self):
        if self.operator not in OPERATORS[self.field]:
            raise TypeError(f"{self.operator} is not an operator of {self.field}")
        if self.operator == "inRange":
            if Decimal(self.minimum) > Decimal(self.maximum):
                raise ValueError("the range's minimum is above its maximum")
        elif not 1 <= len((self.value or "").strip()) <= 240:
            raise ValueError("a value has 1 to 240 characters")

    def column(self) -> Column:
        """The condition over a prepared ledger; null counts as false."""
        names = {"merchantId": "merchant_id", "accountId": "account_id", "accountType": "account_type", "categoryId": "category_id"}
        size = F.abs("amount")
        if self.field == "amount":
            low, high = (self.minimum, self.maximum) if self.operator == "inRange" else (self.value, self.value)
            out = (size >= F.lit(Decimal(low))) & (size <= F.lit(Decimal(high)))
        elif self.field == "direction":
            out = F.when(money.is_inflow(F.col("amount")), "inflow").otherwise("outflow") == self.value
        elif self.field == "tag":
            out = F.array_contains("tags", self.value) if self.operator == "equals" else F.exists("tags", lambda t: t.contains(self.value))
        elif self.field == "normalizedDescription":
            c = F.col("normalized")
            out = {"equals": c == self.value, "startsWith": c.startswith(self.value), "contains": c.contains(self.value)}[self.operator]
        elif self.field == "postedDate":
            out = F.col("posted_date").cast("string") == self.value
        else:
            out = F.col(names[self.field]).cast("string") == self.value
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """set_merchant and set_category are the first action of their kind; other actions are never applied."""

    rule_id: str
    name: str
    priority: int
    conditions: tuple[Condition, ...]
    set_merchant: str | None = None
    set_category: str | None = None
    enabled: bool = True
    ordinal: int = field(default=0)

    def __post_init__(self):
        if not -100_000 <= self.priority <= 100_000 or not 1 <= len(self.conditions) <= 20:
            raise ValueError("priority within 100,000, 1 to 20 conditions")
        if len({c.value for c in self.conditions if c.field == "direction"}) > 1:
            raise ValueError("conditions ask for both directions")

    @property
    def specificity(self) -> int:
        return sum(SPECIFICITY[c.operator] for c in self.conditions)


def numbered(rules: list[Rule]) -> list[Rule]:
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [replace(r, ordinal=i) for i, r in enumerate(rules)]


def prepared(ledger: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The ledger with normalized (description) and account_type (default checking)."""
    out = ledger.withColumn("normalized", text.normalize_merchant(F.col("description")))
    if accounts is None:
        return out.withColumn("account_type", F.lit("checking"))
    return out.join(accounts.select("account_id", "account_type"), "account_id", "left").withColumn("account_type", F.coalesce("account_type", F.lit("checking")))


_RULE = "struct<ordinal:int,rule_id:string,priority:int,specificity:int,merchant:string,category:string>"


def matched(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """The prepared ledger with ``hits``, the enabled rules that hold, in order."""
    hits = []
    for r in numbered(rules):
        if r.enabled:
            holds = F.lit(True)
            for c in r.conditions:
                holds &= c.column()
            values = F.struct(F.lit(r.ordinal), F.lit(r.rule_id), F.lit(r.priority), F.lit(r.specificity), F.lit(r.set_merchant).cast("string"), F.lit(r.set_category).cast("string")).cast(_RULE)
            hits.append(F.when(holds, values))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast(f"array<{_RULE}>")
    return ledger.withColumn("hits", found)


def rule_matches(hit: DataFrame) -> DataFrame:
    """txn_id, rule_id, priority and specificity, a row for each rule that holds."""
    return hit.select("txn_id", F.explode("hits").alias("h")).select("txn_id", "h.rule_id", "h.priority", "h.specificity")


def field_result(hits: Column, value: str, locked: Column) -> Column:
    """status, value, winner and matched (rule ids) of one field: locked; no-match; conflict if the tier with the highest priority and then specificity proposes different values; else matched."""
    own = F.filter(hits, lambda h: h[value].isNotNull())
    tier = lambda h: h["priority"].cast("long") * 1000 + h["specificity"]
    top = F.filter(own, lambda h: tier(h) == F.array_max(F.transform(own, tier)))
    proposed = F.array_distinct(F.transform(top, lambda h: h[value]))
    ids = lambda rules: F.transform(rules, lambda h: h["rule_id"])
    nothing = F.array().cast("array<string>")
    status = F.when(locked, "locked").when(F.size(own) == 0, "no-match").when(F.size(proposed) > 1, "conflict").otherwise("matched")
    good = ~locked & (F.size(proposed) == 1)
    return F.struct(
        status.alias("status"),
        F.when(good, F.get(proposed, F.lit(0))).alias("value"),
        F.when(good, F.array_min(ids(top))).alias("winner"),
        F.when(locked, nothing).when(F.size(proposed) > 1, F.array_sort(ids(top))).otherwise(ids(own)).alias("matched"),
    )


def results(hit: DataFrame, merchant_locked: Column, category_locked: Column) -> DataFrame:
    """``hit`` with merchant_result and category_result."""
    return hit.withColumns({"merchant_result": field_result(F.col("hits"), "merchant", merchant_locked), "category_result": field_result(F.col("hits"), "category", category_locked)})


def impact(hit: DataFrame, rule_id: str, category_locked: Column) -> DataFrame:
    """n_matched, n_locked and n_conflict of one rule; a row can count in several."""
    rows = results(hit, F.col("merchant_id").isNotNull(), F.lit(False)).filter(F.exists("hits", lambda h: h["rule_id"] == rule_id))
    return rows.agg(F.count("*").cast("long").alias("n_matched"), money.count_if(category_locked).alias("n_locked"), money.count_if(F.col("category_result.status") == "conflict").alias("n_conflict"))


def impact_preview(hit: DataFrame, merchant_locked: Column, category_locked: Column, order: Column, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """What all rules together would do: one row of n_total, n_matched, n_locked and n_conflict (a row counts in each that one of its fields has), and the first ``samples`` evaluated rows."""
    rows = results(hit, merchant_locked, category_locked)
    has = lambda status: money.count_if((F.col("merchant_result.status") == status) | (F.col("category_result.status") == status))
    counts = rows.agg(F.count("*").cast("long").alias("n_total"), *[has(s).alias(n) for s, n in (("matched", "n_matched"), ("locked", "n_locked"), ("conflict", "n_conflict"))])
    return counts, rows.orderBy(order).limit(samples)


def overlap(a: Rule, b: Rule) -> str:
    """identical, shadowed (b is, by a), overlapping or distinct; conditions are compared in order."""
    if a.rule_id == b.rule_id:
        return "identical"
    if a.conditions != b.conditions:
        return "distinct"
    return "shadowed" if a.priority > b.priority else "overlapping"


def overlaps(spark, rules: list[Rule]) -> DataFrame:
    """rule_a, rule_b and their overlap, for the pairs with equal conditions: found by an equal join on the conditions."""
    rows = [(r.rule_id, r.priority, repr(r.conditions)) for r in rules]
    df = spark.createDataFrame(rows, "rule_id string, priority int, conditions string")
    a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rule_id", "priority")], "conditions") for p in "ab")
    met = a.join(b, "conditions").filter("a_rule_id <> b_rule_id")
    return met.select(F.col("a_rule_id").alias("rule_a"), F.col("b_rule_id").alias("rule_b"), F.when(F.col("a_priority") > F.col("b_priority"), "shadowed").otherwise("overlapping").alias("overlap"))


def definite_conflicts(rules: list[Rule]) -> list[tuple[str, str]]:
    """Pairs of enabled rules of one priority and one set of conditions that set different values; such a rule can't be saved."""
    seen: dict[tuple, list[Rule]] = {}
    for r in rules:
        if r.enabled:
            seen.setdefault((r.priority, tuple(sorted(map(repr, r.conditions)))), []).append(r)
    differ = lambda x, y: x is not None and y is not None and x != y
    return [(a.rule_id, b.rule_id) for group in seen.values() for i, a in enumerate(group) for b in group[i + 1 :] if differ(a.set_merchant, b.set_merchant) or differ(a.set_category, b.set_category)]


REASONS = ("rule-conflict", "merchant-collision", "rule-changed", "low-confidence", "unclassified")


def review_queue(ledger: DataFrame, rules: list[Rule], first_merchants: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """txn_id, account_id, posted_date, reason, suggested_category and suggested_merchant of the rows that need a look, voids included.

    first_merchants: description and n_merchants of the alias matches. A merchant that is
    set locks the merchant for rules; category_locked is the classification's own lock.
    """
    hit = matched(prepared(ledger, accounts), rules)
    locked = F.coalesce("category_locked", F.lit(False))
    rows = results(hit, F.col("merchant_id").isNotNull(), locked).join(first_merchants.select("description", "n_merchants"), "description", "left")
    suggested = lambda c: F.when(F.col(f"{c}.status") == "matched", F.col(f"{c}.value"))
    changed = suggested("category_result").isNotNull() & F.col("category_id").isNotNull() & (suggested("category_result") != F.col("category_id")) & ~locked
    reason = (
        F.when((F.col("category_result.status") == "conflict") | (F.col("merchant_result.status") == "conflict"), REASONS[0])
        .when(F.col("n_merchants") > 1, REASONS[1])
        .when(changed, REASONS[2])
        .when((F.col("review_state") == "needsReview") & ~locked, REASONS[3])
        .when(F.col("category_id").isNull() & ~locked, REASONS[4])
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select("txn_id", "account_id", "posted_date", "reason", suggested("category_result").alias("suggested_category"), suggested("merchant_result").alias("suggested_merchant"))


def review_counts(queue: DataFrame) -> DataFrame:
    """A row for each reason, also those without rows; before any filter by reason."""
    reasons = queue.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return F.broadcast(reasons).join(queue.groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classify_import(rows: DataFrame, rules: list[Rule], first_merchants: DataFrame) -> DataFrame:
    """New rows classified: a single alias match sets the merchant and locks it for rules, rules set the rest; more than one match or a conflict asks for review."""
    m = first_merchants.select("description", "matched_id", "n_merchants")
    joined = rows.drop("merchant_id").join(m, "description", "left").withColumn("merchant_id", F.when(F.col("n_merchants") == 1, F.col("matched_id")))
    out = results(matched(prepared(joined), rules), F.col("merchant_id").isNotNull(), F.lit(False))
    conflict = (F.col("merchant_result.status") == "conflict") | (F.col("category_result.status") == "conflict")
    return out.select(
        "txn_id",
        F.coalesce("merchant_id", "merchant_result.value").alias("merchant_id"),
        F.col("category_result.value").alias("category_id"),
        F.when(conflict | (F.coalesce("n_merchants", F.lit(0)) > 1), "needsReview").otherwise("unreviewed").alias("review_state"),
    )
