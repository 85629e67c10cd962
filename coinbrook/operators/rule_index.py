"""Classification by an inverted index of rules: a row meets only the rules it has something in common with.

Each rule is filed under one of its conditions: an equal value under that value; the start of
a description under its first characters; a contained text under one of its grams; an amount
range under the one or two cells that cover it, on the finest level where two cells do. The
condition is the one that the fewest rows of the ledger meet, where these have been counted
(``frequencies``), else the one that is rarest by its kind; which it is changes the work and
never the result. A row looks up all its own values, starts, grams and cells, and every rule
so found is tested as a whole. Rules are a table, so the plan is the same for ten and for ten
thousand.

The table of rules (MAX_RULES at most, each of bounded size, which is checked) is sent to all
tasks: the ledger is not shuffled to find rules. Only the hits are, by the row's id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.functions import money
from coinbrook.operators.rules import MAX_RULES, SPECIFICITY, Rule

RULES = "ordinal int, rule_id string, priority int, conditions array<struct<field:string,operator:string,value:string,minimum:string,maximum:string>>, set_merchant string, set_category string, enabled boolean"
#: Characters of a start, and of a gram, at most.
START, GRAM = 8, 3
MAX_CONDITIONS, MAX_VALUE = 20, 240
#: Columns of a prepared ledger that a condition compares by equality.
EQUAL = {"normalizedDescription": "normalized", "merchantId": "merchant_id", "accountId": "account_id", "accountType": "account_type", "categoryId": "category_id", "postedDate": "posted_date"}
#: Conditions from the rarest to the most common.
RARITY = (
    "normalizedDescription equals", "merchantId equals", "postedDate equals", "normalizedDescription startsWith", "accountId equals", "amount equals", "amount inRange",
    "normalizedDescription contains", "tag equals", "categoryId equals", "tag contains", "accountType equals", "direction equals",
)
_EXACT, _HITS = "decimal(38,10)", "array<struct<ordinal:int,rule_id:string,priority:int,specificity:int,merchant:string,category:string>>"


def table_of(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table; their place in the list is their ordinal."""
    rows = [(i, r.rule_id, r.priority, [(c.field, c.operator, c.value, c.minimum, c.maximum) for c in r.conditions], r.set_merchant, r.set_category, r.enabled) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def specificity(conditions: Column) -> Column:
    return F.aggregate(conditions, F.lit(0), lambda n, c: n + F.element_at(_map(SPECIFICITY), c["operator"]))


def cell(amount: Column, level: Column) -> Column:
    """The cell of an amount: whole cents, without their last ``level`` binary digits."""
    whole = F.least(F.greatest(F.floor(amount.cast(_EXACT) * 100), F.lit(0)), F.lit(10**18)).cast("long")
    return F.call_function("shiftright", whole, level)


def _grams(value: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value) - size + 1), lambda i: F.substring(value, i, size))


def rarity(c: Column) -> Column:
    """How rare a condition is by its kind; short starts and grams are common."""
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(RARITY) for x in (name, i)])
    short = c["operator"].isin("startsWith", "contains") & (F.length(c["value"]) < GRAM)
    return F.element_at(rank, F.concat_ws(" ", c["field"], c["operator"])) + F.when(short, len(RARITY)).otherwise(0)


def places(c: Column) -> Column:
    """Where a rule could be filed under condition ``c``: kind and values, one place except for contained texts, which have one for each gram."""
    under = lambda kind, *values: F.struct(kind.alias("kind"), F.array_distinct(F.array(*values)).alias("values"))
    start, size = F.least(F.length(c["value"]), F.lit(START)), F.least(F.length(c["value"]), F.lit(GRAM))
    low, high = F.coalesce(c["minimum"], c["value"]), F.coalesce(c["maximum"], c["value"])
    # Two neighbouring cells of a level hold a range that is no longer than one of them.
    width = cell(high, F.lit(0)) - cell(low, F.lit(0))
    level = F.when(width <= 1, 0).otherwise(F.length(F.bin(width - 1)))
    contained = lambda name: F.transform(F.array_distinct(_grams(c["value"], size)), lambda g: under(F.concat(F.lit(name), size.cast("string")), g))
    return (
        F.when(c["field"] == "amount", F.array(under(F.concat(F.lit("cell"), level.cast("string")), cell(low, level).cast("string"), cell(high, level).cast("string"))))
        .when(c["operator"] == "startsWith", F.array(under(F.concat(F.lit("start"), start.cast("string")), F.substring(c["value"], F.lit(1), start))))
        .when((c["operator"] == "contains") & (c["field"] == "tag"), contained("tag-gram"))
        .when(c["operator"] == "contains", contained("gram"))
        .otherwise(F.array(under(c["field"], c["value"])))
    )


def checked(rules: DataFrame) -> DataFrame:
    """The enabled rules; a table that breaks a limit raises."""
    spark = rules.sparkSession
    # MAX_RULES rows at most come to the driver, once, and go out again as a local table.
    held = rules.limit(MAX_RULES + 1).toArrow()
    if len(held) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    local = spark.createDataFrame(held, rules.schema) if len(held) else spark.createDataFrame([], rules.schema)
    values = F.flatten(F.transform("conditions", lambda c: F.array(c["value"], c["minimum"], c["maximum"])))
    bounded = F.size("conditions").between(1, MAX_CONDITIONS) & F.forall(values, lambda v: v.isNull() | F.length(v).between(1, MAX_VALUE))
    bad = local.filter(~F.coalesce(bounded, F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rules have no condition, too many, or values that are empty or too long")
    return local.filter("enabled")


def options(rules: DataFrame) -> DataFrame:
    """ordinal, at (the condition), rank, kind, values and key: every key of every place where a rule could be filed."""
    each = rules.select("ordinal", F.posexplode("conditions").alias("at", "c"))
    placed = each.select("ordinal", "at", rarity(F.col("c")).alias("rank"), F.explode(places(F.col("c"))).alias("p"))
    return placed.select("ordinal", "at", "rank", "p.kind", "p.values", F.explode("p.values").alias("value")).withColumn("key", F.xxhash64("kind", "value")).drop("value")


def _kinds(table: DataFrame) -> list[str]:
    return [r[0] for r in table.select("kind").distinct().collect()]  # as many as there are fields, lengths, and levels of amounts


def frequencies(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """key and n: rows of the prepared ledger with each key that one of the (``checked``) rules could be filed under. One pass; what is shuffled is a count a key and task."""
    found = options(rules)
    keys, kinds = F.broadcast(found.select("key").distinct()), _kinds(found)
    if not kinds:
        return ledger.sparkSession.createDataFrame([], "key long, n long")
    return ledger.select(F.explode(looked_up(kinds)).alias("key")).join(keys, "key").groupBy("key").agg(F.count("*").alias("n"))


def index(rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """kind, key, low, high (amounts outside can't match), hit and conditions: a row or two for each enabled rule, filed where ``counts`` (key, n) are least; without counts, where its kind is rarest."""
    found = options(rules)
    weighed = found.withColumn("n", F.lit(0)) if counts is None else found.join(counts, "key", "left").fillna(0, ["n"])
    cost = weighed.groupBy("ordinal", "at", "rank", "kind", "values").agg(F.sum("n").alias("n"))
    best = cost.groupBy("ordinal").agg(F.min(F.struct("n", "rank", "at", "kind", "values")).alias("best"))
    hit = F.struct("ordinal", "rule_id", "priority", specificity(F.col("conditions")).alias("specificity"), F.col("set_merchant").alias("merchant"), F.col("set_category").alias("category"))
    sizes = F.filter("conditions", lambda c: c["field"] == "amount")
    low = F.array_max(F.transform(sizes, lambda c: F.coalesce(c["minimum"], c["value"]).cast(_EXACT)))
    high = F.array_min(F.transform(sizes, lambda c: F.coalesce(c["maximum"], c["value"]).cast(_EXACT)))
    filed = rules.join(best, "ordinal").select(hit.alias("hit"), "conditions", low.alias("low"), high.alias("high"), F.col("best.kind").alias("kind"), F.explode("best.values").alias("value"))
    return filed.select("kind", F.xxhash64("kind", "value").alias("key"), "low", "high", "hit", "conditions")


def direction() -> Column:
    return F.when(money.is_inflow(F.col("amount")), "inflow").otherwise("outflow")


def looked_up(kinds: list[str]) -> Column:
    """All keys of a prepared row, of the kinds that some rule is filed under."""
    none, tags = F.array().cast("array<bigint>"), F.coalesce("tags", F.array().cast("array<string>"))

    def of(kind: str) -> Column:
        key = lambda value: F.xxhash64(F.lit(kind), value.cast("string"))
        name, n = re.fullmatch("(.*?)([0-9]*)", kind).groups()
        n = int(n or 0)
        if name == "tag":
            return F.transform(tags, key)
        if name == "tag-gram":
            return F.flatten(F.transform(F.filter(tags, lambda t: F.length(t) >= n), lambda t: F.transform(_grams(t, F.lit(n)), key)))
        if name == "gram":
            return F.when(F.length("normalized") >= n, F.transform(_grams(F.col("normalized"), F.lit(n)), key))
        if name == "start":
            return F.when(F.length("normalized") >= n, F.array(key(F.substring("normalized", 1, n))))
        value = cell(F.abs("amount"), F.lit(n)) if name == "cell" else direction() if name == "direction" else F.col(EQUAL[name])
        return F.when(value.isNotNull(), F.array(key(value)))

    return F.array_distinct(F.concat(none, *[F.coalesce(of(k), none) for k in sorted(kinds)]))


def holds(c: Column) -> Column:
    """Condition ``c`` over a prepared row; what is unknown does not hold."""
    size, value = F.abs("amount").cast(_EXACT), c["value"]
    text = F.when(c["operator"] == "equals", F.col("normalized") == value).when(c["operator"] == "startsWith", F.col("normalized").startswith(value)).otherwise(F.col("normalized").contains(value))
    tag = F.when(c["operator"] == "equals", F.array_contains("tags", value)).otherwise(F.exists("tags", lambda t: t.contains(value)))
    out = F.when(c["field"] == "amount", size.between(F.coalesce(c["minimum"], value).cast(_EXACT), F.coalesce(c["maximum"], value).cast(_EXACT))).when(c["field"] == "normalizedDescription", text).when(c["field"] == "tag", tag).when(c["field"] == "direction", direction() == value)
    for name, column in EQUAL.items():
        if name != "normalizedDescription":
            out = out.when(c["field"] == name, F.col(column).cast("string") == value)
    return F.coalesce(out, F.lit(False))


def rule_hits(ledger: DataFrame, rules: DataFrame, key: str = "txn_id", counted: bool = True) -> DataFrame:
    """``key`` and hit, a row for each enabled rule that holds for a row of the prepared ledger. ``counted``: rules are filed by ``frequencies``, for one more pass over the ledger."""
    some = checked(rules)
    held = index(some, frequencies(ledger, some) if counted else None).toArrow()  # two rows a rule at most
    if not len(held):
        return ledger.select(key, F.get(F.array().cast(_HITS), 0).alias("hit")).limit(0)
    made = ledger.sparkSession.createDataFrame(held)
    kinds = sorted(set(held.column("kind").to_pylist()))
    need = [key, "amount", "tags", *EQUAL.values()]
    each = ledger.select(*dict.fromkeys(need), F.explode(looked_up(kinds)).alias("key_of_rule"))
    met = each.join(F.broadcast(made.drop("kind").withColumnRenamed("key", "key_of_rule")), "key_of_rule")
    size = F.abs("amount").cast(_EXACT)
    # Bounds are plain columns, so most of what only shares a key falls before conditions are read.
    near = (F.col("low").isNull() | (size >= F.col("low"))) & (F.col("high").isNull() | (size <= F.col("high")))
    return met.filter(near).filter(F.forall("conditions", holds)).select(key, "hit")


def matched(ledger: DataFrame, rules: DataFrame, key: str = "txn_id", counted: bool = True) -> DataFrame:
    """The prepared ledger with ``hits``, the enabled rules that hold, in order. ``key`` tells rows apart."""
    hits = rule_hits(ledger, rules, key, counted).groupBy(key).agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    return ledger.join(hits, key, "left").withColumn("hits", F.coalesce(F.col("hits").cast(_HITS), F.array().cast(_HITS)))
