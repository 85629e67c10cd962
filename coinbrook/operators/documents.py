"""Canonical documents: JSON with sorted keys at every level, transactions as such documents and back, checks of a knowledge document, and a digest of many rows.

JSON is parsed to VARIANT, whose objects keep their keys in order; text that is no JSON, or
that gives one key twice, is null. All is done by built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import money

#: The version of documents, the size of a knowledge document, and keys that it may not have.
VERSION = "1.0.0"
MAX_BRAIN_BYTES = 10 * 1024 * 1024
PROHIBITED = ("transactions", "accounts", "imports", "statements", "secrets", "apiKeys", "balances")
#: Levels of nesting that ``key_paths`` follows, and those of a transaction's document.
DEPTH, LEVELS = 64, 3

_CLASSIFICATION = "struct<value:string,source:string,locked:boolean>"
DOCUMENT = (
    "schemaVersion string, id string, accountId string, importId string, postedDate string, transactionDate string, amount string, currency string, description string, sourceTransactionId string, "
    f"merchantId string, categoryId string, notes string, tags array<string>, status string, reviewState string, classifications struct<category:{_CLASSIFICATION},merchant:{_CLASSIFICATION}>, createdAt string, updatedAt string"
)
#: Column of the ledger, by key; those that are null are left out of a document.
_FIELDS = {"id": "txn_id", "accountId": "account_id", "importId": "import_id", "sourceTransactionId": "source_id", "merchantId": "merchant_id", "categoryId": "category_id", "notes": "notes", "description": "description", "currency": "currency", "status": "status", "reviewState": "review_state", "createdAt": "created_at", "updatedAt": "updated_at"}
_REQUIRED = ("id", "accountId", "postedDate", "amount", "currency", "description", "status", "reviewState", "tags")


def parsed(body: Column) -> Column:
    """JSON text as VARIANT; null if it is no JSON. The parser stops after the first value, so what follows is found out by putting the text between brackets of both kinds."""

    def value(text: Column) -> Column:
        whole = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
        return _bound(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), lambda inner: F.when(whole & F.variant_get(inner, "$[1]", "variant").isNull(), F.variant_get(inner, "$[0]", "variant")))

    return _bound(body, value)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, where the optimizer would copy it into each use."""
    return F.get(F.transform(F.array(value), of), 0)


def canonical(body: Column) -> Column:
    """JSON text with its keys sorted at every level and no blanks between; null if it is no JSON."""
    return F.to_json(parsed(body))


def transaction_documents(ledger: DataFrame) -> DataFrame:
    """txn_id and document, the canonical document of each row; columns that the ledger does not have count as unknown. Fields are put in order here, so that a document is written once and not parsed."""
    have = set(ledger.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    one = lambda value, lock: F.when(col(value).isNotNull() | col(lock).cast("boolean"), F.struct(F.coalesce(col(lock).cast("boolean"), F.lit(False)).alias("locked"), col(value).cast("string").alias("value")))
    parts = {k: col(c).cast("string") for k, c in _FIELDS.items()} | {
        "schemaVersion": F.lit(VERSION), "postedDate": col("posted_date").cast("string"), "transactionDate": col("transaction_date").cast("string"),
        "amount": money.render(F.col("amount")), "tags": F.coalesce(col("tags").cast("array<string>"), F.array().cast("array<string>")),
        "classifications": F.struct(one("category_id", "category_locked").alias("category"), one("merchant_id", "merchant_locked").alias("merchant")),
    }
    return ledger.select("txn_id", F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])).alias("document"))


def decoded(documents: DataFrame) -> DataFrame:
    """Rows (document) with problem and the columns of a ledger; what is refused has a problem and no columns."""

    def read(v: Column, d: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        missing = F.filter(F.array(*[F.when(d[k].isNull(), F.lit(k)) for k in _REQUIRED]), lambda x: x.isNotNull())
        amount = d["amount"].try_cast("decimal(38,10)")
        day = lambda k: F.when(d[k].rlike(r"^\d{4}-\d{2}-\d{2}$"), d[k].try_cast("date"))
        tags = F.coalesce(d["tags"], F.array().cast("array<string>"))
        problem = (
            F.when(v.isNull(), "no JSON")
            .when(~is_object, "no object")
            .when(~d["schemaVersion"].eqNullSafe(VERSION), "unsupported version")
            .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
            .when(amount.isNull() | ~d["amount"].rlike(r"^-?\d+(\.\d+)?$"), "invalid amount")
            .when(day("postedDate").isNull() | (d["transactionDate"].isNotNull() & day("transactionDate").isNull()), "invalid date")
            .when(~d["currency"].rlike("^[A-Z]{3}$"), "invalid currency")
            .when(~d["status"].isin("pending", "posted", "void"), "invalid status")
            .when(~d["reviewState"].isin("unreviewed", "needsReview", "reviewed"), "invalid review state")
            .when(~F.length(F.trim(d["description"])).between(1, 1000), "invalid description")
            .when((F.size(tags) > 50) | (F.size(F.array_distinct(tags)) < F.size(tags)) | F.exists(tags, lambda t: ~F.length(t).between(1, 60)), "invalid tags")
        )
        columns = [d[k].alias(c) for k, c in _FIELDS.items()] + [day("postedDate").alias("posted_date"), day("transactionDate").alias("transaction_date"), amount.alias("amount"), tags.alias("tags")]
        locks = [F.coalesce(d["classifications"][k]["locked"], F.lit(False)).alias(f"{k}_locked") for k in ("category", "merchant")]
        return F.struct(problem.alias("problem"), F.struct(*columns, *locks).alias("row"))

    # Parsed once a row, whatever is asked of it.
    one = _bound(F.col("document"), lambda text: _bound(F.struct(parsed(text).alias("v"), F.from_json(text, DOCUMENT).alias("d")), lambda x: read(x["v"], x["d"])))
    rows = documents.withColumn("_one", one)
    return rows.select(*documents.columns, F.col("_one.problem").alias("problem"), F.when(F.col("_one.problem").isNull(), F.col("_one.row")).alias("_row")).select(*documents.columns, "problem", "_row.*")


def key_paths(documents: DataFrame, key: str, body: str, levels: int | None = None) -> DataFrame:
    """``key``, path, name and depth of every key of every object in JSON documents; elements of arrays stand in a path as []. Levels stop where none has children, at DEPTH at most.

    Each document is parsed once and opened level after level in one task. ``levels``: how many a
    document has at most, where its schema says so (one with more is an error); else a first pass
    counts the brackets that a document opens, which are no fewer.
    """
    spark = documents.sparkSession
    if levels is None:
        opened = F.octet_length(F.col(body)) - F.octet_length(F.replace(F.replace(F.col(body), F.lit("{")), F.lit("[")))
        steps = min(documents.agg(F.max(opened).alias("n")).first()["n"] or 0, DEPTH)
    else:
        steps = levels
    explode = lambda rows: rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
    # A text that is JSON between brackets of both kinds is one value (see ``parsed``).
    text = documents.select(F.col(key).alias("k"), F.col(body).alias("text"))
    whole = F.try_parse_json(F.concat(F.lit('{"x":'), "text", F.lit("}"))).isNotNull()
    rows = explode(text.select("k", F.when(whole, F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]")))).alias("v")))
    found = "array<struct<path:string,name:string,depth:int>>"
    rows = rows.select("k", F.lit("").alias("path"), F.array().cast(found).alias("found"), F.col("value").alias("v"))
    for depth in range(1, steps + 1):
        # The first child, or the row itself if it has none, takes along what was found above it.
        path = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("/"), "key")).when(F.col("pos").isNotNull(), F.concat("path", F.lit("[]"))).otherwise(F.col("path"))
        each = explode(rows).select("k", path.alias("path"), F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("found")).otherwise(F.array().cast(found)).alias("above"), F.col("key").alias("name"), F.col("value").alias("v"))
        own = F.array(F.struct("path", "name", F.lit(depth).alias("depth")))
        rows = each.select("k", "path", F.when(F.col("name").isNull(), F.col("above")).otherwise(F.concat("above", own)).alias("found"), "v")
    if levels is not None:
        deeper = F.schema_of_variant("v").rlike("^(OBJECT<[^>]|ARRAY<(?!VOID>$))")
        rows = rows.withColumn("found", F.when(F.coalesce(deeper, F.lit(False)), F.raise_error(F.concat(F.lit(f"more than {levels} levels: "), "path"))).otherwise(F.col("found")))
    return rows.select(F.col("k").alias(key), F.explode("found").alias("e")).select(key, "e.path", "e.name", "e.depth")


_ITEM = "array<struct<id:string,name:string,parentId:string,redirectToId:string>>"
_BRAIN = f"schemaVersion string, brainId string, createdAt string, updatedAt string, categories {_ITEM}, merchants {_ITEM}, rules {_ITEM}, recurringDecisions {_ITEM}"


def brain_problems(documents: DataFrame, key: str, body: str) -> DataFrame:
    """``key``, step and problem of knowledge documents that may not be read: every problem of the first step that finds any.

    Steps: size, JSON, prohibited keys, required keys and version, repeated ids, references. A
    document's lists are exploded, so no document is compared in one row.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(body).alias("body")).withColumn("v", F.when(F.octet_length("body") <= MAX_BRAIN_BYTES, F.try_parse_json("body")))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    said = lambda step, problem: F.struct(F.lit(step).alias("step"), F.lit(problem).alias("problem"))
    early = F.when(F.octet_length("body") > MAX_BRAIN_BYTES, said(1, "too large")).when(F.col("v").isNull(), said(2, "no JSON")).when(~is_object, said(2, "no object"))
    out = [rows.select("k", early.alias("e")).filter("e is not null").select("k", "e.step", "e.problem")]
    objects = rows.filter(is_object).withColumn("b", F.from_json("body", _BRAIN)).withColumn("names", F.map_keys(F.from_json("body", "map<string,string>")))
    bad = F.explode(F.array_intersect("names", F.array(*map(F.lit, PROHIBITED))))
    out.append(objects.select("k", F.lit(3).alias("step"), bad.alias("x")).select("k", "step", F.concat(F.lit("prohibited "), "x").alias("problem")))
    missing = F.array(*[F.when(F.col(f"b.{c}").isNull(), F.lit(f"missing {c}")) for c in ("brainId", "createdAt", "updatedAt", "categories", "merchants", "rules", "recurringDecisions")], F.when(~F.col("b.schemaVersion").eqNullSafe(VERSION), F.lit("unsupported version")))
    out.append(objects.select("k", F.lit(4).alias("step"), F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("problem")))
    for kind in ("categories", "merchants", "rules"):
        items = objects.select("k", F.explode(f"b.{kind}").alias("i")).select("k", "i.*")
        twice = items.groupBy("k", "id").agg(F.count("*").alias("n")).filter("n > 1")
        out.append(twice.select("k", F.lit(5).alias("step"), F.concat(F.lit(f"repeated id in {kind}: "), F.coalesce("id", F.lit("null"))).alias("problem")))
        link = {"categories": "parentId", "merchants": "redirectToId"}.get(kind)
        if link:
            lost = items.filter(F.col(link).isNotNull()).join(items.select("k", F.col("id").alias(link)).distinct(), ["k", link], "left_anti")
            out.append(lost.select("k", F.lit(6).alias("step"), F.concat(F.lit(f"no {link} "), F.col(link)).alias("problem")))
    found = reduce(DataFrame.unionByName, out)
    first = found.groupBy("k").agg(F.min("step").alias("step"))
    return found.join(first, ["k", "step"]).select(F.col("k").alias(key), "step", "problem")


#: Hexadecimal digits of a row's digest that name its leaf, and its branch, of the tree of digests.
LEAF, BRANCH = 6, 3


def leaves(rows: DataFrame, body: Column) -> DataFrame:
    """leaf and digest: rows are dealt to leaves by their own digest, equal rows counted first, and a leaf's digests folded in their order. 16^LEAF leaves, so that one stays small."""
    own = rows.select(F.sha2(body.cast("binary"), 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    item = F.concat("d", F.lit(":"), F.col("n").cast("string"))
    return own.groupBy(F.substring("d", 1, LEAF).alias("leaf")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(item)), ",").cast("binary"), 256).alias("digest"))


def revision(rows: DataFrame, body: Column) -> DataFrame:
    """One row, n_leaves and digest: the root of a tree of digests over the multiset of ``body``. It does not depend on how rows are dealt to partitions, and changes with any edit."""
    tree = leaves(rows, body)
    join = lambda of: F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(of, F.lit(":"), "digest"))), ",").cast("binary"), 256)
    branches = tree.groupBy(F.substring("leaf", 1, BRANCH).alias("branch")).agg(join("leaf").alias("digest"), F.count("*").alias("n"))
    return branches.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_leaves"), join("branch").alias("digest"))


def changed_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves whose rows differ between two trees (``leaves``): where to look for what has changed."""
    both = before.withColumnRenamed("digest", "old").join(after.withColumnRenamed("digest", "new"), "leaf", "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("leaf")
