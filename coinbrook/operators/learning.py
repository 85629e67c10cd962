"""Learning operations: changes of several tables as one, journaled with before and after images, and undone.

An operation's changes are rows (store, key, before, after); images are JSON of a whole row,
null where the row did not exist or is deleted. ``apply`` writes all stores and the journal
in one revision of the workspace; ``undo`` takes the images back, last change first, only if
every after image still is what the store holds. The journal is a log of events; which
operations are undone is a fold over it.

The stores of a review correction are the ledger (``transactions``, key txn_id), the rules
(``rules``, key rule_id) and the aliases (``aliases``, key alias_id).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from coinbrook.functions import text
from coinbrook.operators.ledger import Edit, edited
from coinbrook.streaming import snapshots
from coinbrook.streaming.snapshots import RevisionConflict, Snapshot

STORES = {"transactions": "txn_id", "rules": "rule_id", "aliases": "alias_id"}
CHANGES = "store string, key string, before string, after string"
RULES = "rule_id string, name string, priority int, conditions array<struct<field:string,operator:string,value:string,minimum:string,maximum:string>>, set_merchant string, set_category string, enabled boolean"
JOURNAL = "journal"
#: Fixed value: operations that the journal shows.
SHOWN = 1000


class CorrectionRefused(ValueError):
    """An operation that may not be applied; nothing has been written."""


def image(columns: list[str]) -> Column:
    """A row as JSON with its columns in alphabetical order, unknown values included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def images(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("string").alias("key"), image(table.columns).alias("now"))


@dataclass(frozen=True)
class NewRule:
    rule_id: str
    name: str
    conditions: tuple[tuple[str, str, str], ...]
    priority: int = 0
    set_merchant: str | None = None
    set_category: str | None = None


@dataclass(frozen=True)
class NewAlias:
    alias_id: str
    merchant_id: str
    pattern: str
    match_mode: str = "tokenPrefix"


def transaction_changes(ledger: DataFrame, ids: DataFrame, edit: Edit) -> DataFrame:
    """Changes of the selected rows that ``edit`` changes."""
    chosen = ledger.join(ids.select("txn_id").distinct(), "txn_id", "left_semi").withColumn("before", image(ledger.columns))
    both = edited(chosen, edit).withColumn("after", image(ledger.columns))
    return both.filter("before <> after").select(F.lit("transactions").alias("store"), F.col("txn_id").cast("string").alias("key"), "before", "after")


def canonical_conditions(conditions: Column) -> Column:
    """Conditions as a set, whatever their order."""
    return F.to_json(F.array_sort(F.transform(conditions, lambda c: F.to_json(c))))


def rule_changes(rules: DataFrame, new: NewRule) -> DataFrame:
    """The change that adds a rule; an id that is taken and a definite conflict (same priority and conditions, another value) are refused."""
    spark = rules.sparkSession
    conditions = [(*c, None, None) for c in new.conditions]
    row = spark.createDataFrame([(new.rule_id, new.name, new.priority, conditions, new.set_merchant, new.set_category, True)], RULES)
    same = F.broadcast(row.select(canonical_conditions("conditions").alias("wanted"), F.col("priority").alias("p")))  # one row
    differs = lambda c, v: F.col(c).isNotNull() & (F.col(c) != F.lit(v)) if v is not None else F.lit(False)
    clash = (F.col("rule_id") == new.rule_id).alias("taken"), (F.col("enabled") & F.col("wanted").isNotNull() & (differs("set_merchant", new.set_merchant) | differs("set_category", new.set_category))).alias("conflict")
    found = rules.withColumn("own", canonical_conditions("conditions")).join(same, (F.col("own") == F.col("wanted")) & (F.col("priority") == F.col("p")), "left").agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in clash]).first()
    if found[0]:
        raise CorrectionRefused(f"rule {new.rule_id} exists already")
    if found[1]:
        raise CorrectionRefused("another rule of this priority and these conditions sets another value")
    return row.select(F.lit("rules").alias("store"), F.col("rule_id").alias("key"), F.lit(None).cast("string").alias("before"), image(row.columns).alias("after"))


def alias_changes(aliases: DataFrame, merchants: DataFrame, new: NewAlias) -> DataFrame:
    """The change that adds an alias to a known merchant; none if the merchant has it already."""
    spark = aliases.sparkSession
    if merchants.filter(F.col("merchant_id") == new.merchant_id).isEmpty():
        raise CorrectionRefused(f"no merchant {new.merchant_id}")
    row = spark.createDataFrame([(new.alias_id, new.merchant_id, new.pattern, new.match_mode)], "alias_id string, merchant_id string, pattern string, match_mode string").withColumn("pattern", text.normalize_merchant(F.col("pattern")))
    if row.filter(F.length("pattern").between(1, 240)).isEmpty():
        raise CorrectionRefused("an alias has 1 to 240 characters")
    fresh = row.join(aliases.select("merchant_id", "pattern", "match_mode"), ["merchant_id", "pattern", "match_mode"], "left_anti")
    return fresh.select(F.lit("aliases").alias("store"), F.col("alias_id").alias("key"), F.lit(None).cast("string").alias("before"), image(["alias_id", "merchant_id", "pattern", "match_mode"]).alias("after"))


def parsed(body: Column, schema: StructType) -> Column:
    return F.from_json(body, StructType([StructField(f.name, f.dataType, True) for f in schema.fields]))


def _written(spark: SparkSession, path: str, at: Snapshot, changes: DataFrame, event: DataFrame) -> Snapshot:
    """All stores that ``changes`` touch, and the journal's event, as one revision."""
    new = {JOURNAL: snapshots.Change(event)}
    for (store,) in changes.select("store").distinct().collect():
        key, table = STORES[store], snapshots.table(spark, path, at, store)
        schema = StructType([f for f in table.schema.fields if f.name != key])
        own = changes.filter(F.col("store") == store).select(F.col("key").cast(table.schema[key].dataType).alias(key), parsed(F.col("after"), schema).alias("after"))
        new[store] = snapshots.upserted(spark, path, at, store, key, own)
    return snapshots.commit(spark, path, at, new)


def stale_changes(spark: SparkSession, path: str, at: Snapshot, changes: DataFrame, side: str) -> DataFrame:
    """Changes whose ``side`` image is not what the store holds: the row has other values, is gone, or exists where it should not."""
    out = changes.limit(0)
    for store, key in STORES.items():
        table = snapshots.table(spark, path, at, store)
        if table is not None:
            own = changes.filter(F.col("store") == store)
            out = out.unionByName(own.join(images(table, key), "key", "left").filter(~F.col("now").eqNullSafe(F.col(side))).select(*changes.columns))
    return out


def _event(changes: DataFrame, operation_id: str, kind: str, at: datetime) -> DataFrame:
    return changes.select(F.lit(operation_id).alias("operation_id"), F.lit(kind).alias("kind"), F.lit(at).cast("timestamp").alias("at"), *[f.split()[0] for f in CHANGES.split(", ")])


def history(spark: SparkSession, path: str, at: Snapshot) -> DataFrame:
    """operation_id, kind, created_at, undone_at and n_changes of each operation, newest first; SHOWN at most."""
    log = snapshots.table(spark, path, at, JOURNAL)
    if log is None:
        return spark.createDataFrame([], "operation_id string, kind string, created_at timestamp, undone_at timestamp, n_changes long")
    undo = F.col("kind") == "undo"
    each = log.groupBy("operation_id").agg(F.max(F.when(~undo, F.col("kind"))).alias("kind"), F.min(F.when(~undo, F.col("at"))).alias("created_at"), F.max(F.when(undo, F.col("at"))).alias("undone_at"), F.count_if(~undo).alias("n_changes"))
    return each.orderBy(F.desc("created_at"), F.desc("operation_id")).limit(SHOWN)


def apply(spark: SparkSession, path: str, operation_id: str, kind: str, changes: DataFrame, now: datetime, at: Snapshot) -> Snapshot:
    """Writes an operation's changes; refused if its id is known, if it changes nothing, or if a before image is not what the store holds."""
    log = snapshots.table(spark, path, at, JOURNAL)
    if log is not None and not log.filter(F.col("operation_id") == operation_id).isEmpty():
        raise CorrectionRefused(f"operation {operation_id} exists already")
    if changes.isEmpty():
        raise CorrectionRefused("nothing would change")
    if not stale_changes(spark, path, at, changes, "before").isEmpty():
        raise RevisionConflict("a row has changed meanwhile")
    return _written(spark, path, at, changes, _event(changes, operation_id, kind, now))


def undo(spark: SparkSession, path: str, operation_id: str, now: datetime, at: Snapshot) -> Snapshot:
    """Takes an operation back, all stores in one revision; refused if it is unknown, undone, or if a row has changed since."""
    log = snapshots.table(spark, path, at, JOURNAL)
    own = log.filter(F.col("operation_id") == operation_id) if log is not None else None
    if own is None or own.filter("kind <> 'undo'").isEmpty():
        raise CorrectionRefused(f"no operation {operation_id}")
    if not own.filter("kind = 'undo'").isEmpty():
        raise CorrectionRefused(f"operation {operation_id} is undone")
    changes = own.select(*[f.split()[0] for f in CHANGES.split(", ")])
    if not stale_changes(spark, path, at, changes, "after").isEmpty():
        raise RevisionConflict("a row has changed since")
    back = changes.select("store", "key", F.col("after").alias("before"), F.col("before").alias("after"))
    return _written(spark, path, at, back, _event(back, operation_id, "undo", now))


def correct(spark: SparkSession, path: str, operation_id: str, ids: DataFrame, edit: Edit, now: datetime, rule: NewRule | None = None, alias: NewAlias | None = None, at: Snapshot | None = None) -> Snapshot:
    """A review correction: an edit of selected transactions, with a rule and an alias learned from it, as one operation."""
    at = at or snapshots.newest(spark, path)
    if ids.isEmpty():
        raise CorrectionRefused("no transaction is selected")
    tables = snapshots.read(spark, path, at)
    changes = transaction_changes(tables["transactions"], ids, edit)
    if rule is not None:
        changes = changes.unionByName(rule_changes(tables["rules"], rule))
    if alias is not None:
        changes = changes.unionByName(alias_changes(tables["aliases"], tables["merchants"], alias))
    return apply(spark, path, operation_id, "review-correction", changes, now, at)
