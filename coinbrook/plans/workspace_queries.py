"""Workspaces of several tables, learning operations, the rule index, documents and digests, over the tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.operators import documents, learning, rule_index, rules
from coinbrook.operators.ledger import Edit
from coinbrook.plans import ledgers as L
from coinbrook.plans.match_queries import _SERIES
from coinbrook.plans.text_queries import merchant_sql
from coinbrook.streaming import series, snapshots
from coinbrook.streaming.snapshots import Change

QUERIES: dict = {}
NOW = datetime(2026, 7, 1)


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


def fresh(spark) -> str:
    """A new workspace's folder."""
    return f"{snapshots.shared_dir(spark)}/workspace-{uuid.uuid4().hex}"


# Two tables under one revision: half of the ledger with all customers, then the other half with nine in ten of them.


def _two_commits(spark, sf_dir) -> tuple[str, list[snapshots.Snapshot]]:
    path, rows, customers = fresh(spark), L.ledger(spark, sf_dir), L.table(spark, sf_dir, "customer")
    everyone = customers.select(F.col("c_custkey").alias("account_id"), F.lit("all").alias("state"))
    some = L.accounts(spark, sf_dir).select("account_id", F.lit("known").alias("state"))
    first = snapshots.commit(spark, path, snapshots.Snapshot(), {"transactions": Change(rows.filter("txn_id % 2 = 0")), "accounts": Change(everyone)})
    second = snapshots.commit(spark, path, first, {"transactions": Change(rows.filter("txn_id % 2 <> 0")), "accounts": snapshots.replaced(some)})
    return path, [first, second]


@register(f"""WITH {L.LEDGER} SELECT CAST(1 AS BIGINT) AS revision, 'all' AS state, currency, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM ledger WHERE txn_id % 2 = 0 GROUP BY currency
UNION ALL SELECT 2, 'known', currency, count(*), CAST(sum(amount) AS DECIMAL(38,2)) FROM ledger WHERE account_id % 10 <> 0 GROUP BY currency""")
def snapshot_revisions(spark, sf_dir):
    """Both revisions, read after both commits: each has its own pair of tables."""
    path, made = _two_commits(spark, sf_dir)
    out = []
    for at in made:
        tables = snapshots.read(spark, path, snapshots.at_revision(spark, path, at.number))
        joined = tables["transactions"].join(tables["accounts"], "account_id")
        out.append(joined.groupBy("state", "currency").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total")).select(F.lit(at.number).cast("long").alias("revision"), "state", "currency", "n", "total"))
    return out[0].unionByName(out[1])


# A review correction over the whole ledger: ledger, rules and aliases as one, and the second of two taken back.

_CORRECTED = f"""WITH {L.LEDGER}, done AS (SELECT txn_id, currency, amount, CASE WHEN category_id IS NULL THEN 'misc' ELSE category_id END AS category_id, CASE WHEN category_id IS NULL THEN 'reviewed' ELSE review_state END AS review_state, category_id IS NULL AS locked FROM ledger)"""


def _workspace(spark, sf_dir) -> str:
    path = fresh(spark)
    rows = L.ledger(spark, sf_dir).withColumns({"category_locked": F.lit(False), "merchant_locked": F.lit(False)})
    customers = L.table(spark, sf_dir, "customer")
    tables = {
        "transactions": rows,
        "rules": customers.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("rule_id"), F.col("c_name").alias("name"), F.lit(1).alias("priority"), F.expr("array(struct('accountId' AS field, 'equals' AS operator, CAST(c_custkey AS STRING) AS value, CAST(NULL AS STRING) AS minimum, CAST(NULL AS STRING) AS maximum))").alias("conditions"), F.lit(None).cast("string").alias("set_merchant"), F.col("c_mktsegment").alias("set_category"), F.lit(True).alias("enabled")),
        "aliases": customers.select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("alias_id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("merchant_id"), F.lower("c_mktsegment").alias("pattern"), F.lit("exact").alias("match_mode")),
        "merchants": customers.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("merchant_id")),
    }
    snapshots.commit(spark, path, snapshots.Snapshot(), {n: Change(t) for n, t in tables.items()})
    return path


def _corrected(spark, sf_dir) -> tuple[str, snapshots.Snapshot]:
    path = _workspace(spark, sf_dir)
    at = snapshots.newest(spark, path)
    ids = snapshots.table(spark, path, at, "transactions").filter("category_id IS NULL").select("txn_id")
    rule = learning.NewRule("learned", "misc", (("normalizedDescription", "contains", "low"),), 3, set_category="misc")
    return path, learning.correct(spark, path, "first", ids, Edit(category_id="misc", review_state="reviewed"), NOW, rule, learning.NewAlias("learned", "m1", "POS Low 5", "contains"), at)


def _ledger_state(spark, path: str, at: snapshots.Snapshot) -> DataFrame:
    rows = snapshots.table(spark, path, at, "transactions")
    return rows.groupBy("currency", "category_id", "review_state", F.col("category_locked").alias("locked")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))


_STATE = "SELECT currency, category_id, review_state, locked, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM done GROUP BY ALL"


@register(f"{_CORRECTED} {_STATE}")
def correction_applied(spark, sf_dir):
    path, at = _corrected(spark, sf_dir)
    return _ledger_state(spark, path, at)


@register(f"{_CORRECTED} {_STATE}")
def correction_second_undone(spark, sf_dir):
    """A second correction changes every row and is taken back: the first one's state is left."""
    path, at = _corrected(spark, sf_dir)
    ids = snapshots.table(spark, path, at, "transactions").select("txn_id")
    at = learning.correct(spark, path, "second", ids, Edit(category_id="other", review_state="needsReview"), NOW, at=at)
    return _ledger_state(spark, path, learning.undo(spark, path, "second", NOW, at))


@register("""SELECT 'rules' AS store, rule_id AS key, set_category AS content FROM (SELECT 'r' || c_custkey AS rule_id, c_mktsegment AS set_category FROM customer UNION ALL SELECT 'learned', 'misc')
UNION ALL SELECT 'aliases', alias_id, merchant_id || ' ' || pattern FROM (SELECT 'a' || c_custkey AS alias_id, 'm' || c_custkey AS merchant_id, lower(c_mktsegment) AS pattern FROM customer UNION ALL SELECT 'learned', 'm1', 'low 5')""")
def correction_learned(spark, sf_dir):
    """Rules and aliases after the correction."""
    path, at = _corrected(spark, sf_dir)
    made = snapshots.table(spark, path, at, "rules").select(F.lit("rules").alias("store"), F.col("rule_id").alias("key"), F.col("set_category").alias("content"))
    known = snapshots.table(spark, path, at, "aliases").select(F.lit("aliases").alias("store"), F.col("alias_id").alias("key"), F.concat_ws(" ", "merchant_id", "pattern").alias("content"))
    return made.unionByName(known)


@register(f"""WITH {L.LEDGER} SELECT 'first' AS operation_id, 'transactions' AS store, false AS undone, CAST(count(*) FILTER (category_id IS NULL) AS BIGINT) AS n FROM ledger UNION ALL SELECT 'first', 'rules', false, 1 UNION ALL SELECT 'first', 'aliases', false, 1
UNION ALL SELECT 'second', 'transactions', true, count(*) FROM ledger""")
def correction_journal(spark, sf_dir):
    """Changes by operation and store, and whether they were taken back; every change has both images."""
    path, at = _corrected(spark, sf_dir)
    ids = snapshots.table(spark, path, at, "transactions").select("txn_id")
    at = learning.correct(spark, path, "second", ids, Edit(category_id="other"), NOW, at=at)
    log = snapshots.table(spark, path, learning.undo(spark, path, "second", NOW, at), learning.JOURNAL)
    undone = log.groupBy("operation_id").agg(F.bool_or(F.col("kind") == "undo").alias("undone"))
    return log.filter("kind <> 'undo'").groupBy("operation_id", "store").agg(F.count("*").alias("n")).join(undone, "operation_id").select("operation_id", "store", "undone", "n")


# Ten thousand rules, made from the first orders, against all orders.

_RULE_SOURCE = f"""WITH {L.LEDGER}, n AS (SELECT *, {merchant_sql('description')} AS normalized, CASE WHEN amount >= 0 THEN 'inflow' ELSE 'outflow' END AS direction, abs(amount) AS size FROM ledger),
r AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY txn_id) - 1 AS i, * FROM n) WHERE i < 10000),
near AS (SELECT i, i % 6 AS kind, account_id, posted_date, normalized, size - w AS low, size + w AS high FROM (SELECT *, CASE i % 6 WHEN 0 THEN 50 WHEN 1 THEN 20 WHEN 3 THEN 5 ELSE 10 END AS w FROM r)),
hits AS (SELECT n.txn_id, i, 15 AS points FROM n JOIN near q ON kind = 0 AND n.normalized = q.normalized AND size BETWEEN low AND high
UNION ALL SELECT n.txn_id, i, 10 FROM n JOIN near q ON kind = 1 AND left(n.normalized, 6) = left(q.normalized, 6) AND size BETWEEN low AND high
UNION ALL SELECT n.txn_id, i, 20 FROM n JOIN near q ON kind = 2 AND n.account_id = q.account_id AND direction = 'outflow'
UNION ALL SELECT n.txn_id, i, 5 FROM n JOIN near q ON kind = 3 AND size BETWEEN low AND high
UNION ALL SELECT n.txn_id, i, 7 FROM n JOIN near q ON kind = 4 AND size BETWEEN low AND high AND contains(n.normalized, substr(q.normalized, 2, 5))
UNION ALL SELECT n.txn_id, i, 20 FROM n JOIN near q ON kind = 5 AND n.posted_date = q.posted_date AND list_contains(tags, 'home')),
named AS (SELECT txn_id, 'r' || i AS rule_id, 'c' || (i % 7) AS category, (i % 4) * 1000 + points AS tier FROM hits),
tops AS (SELECT *, max(tier) OVER (PARTITION BY txn_id) AS top FROM named),
found AS (SELECT txn_id, CAST(count(*) AS BIGINT) AS n_hits, count(DISTINCT category) FILTER (tier = top) AS n_values, min(category) FILTER (tier = top) AS category, min(rule_id) FILTER (tier = top) AS winner FROM tops GROUP BY txn_id)"""


def _many_rules(rows: DataFrame) -> DataFrame:
    first = rows.orderBy("txn_id").limit(10_000)
    i = F.row_number().over(Window.orderBy("txn_id")) - 1  # over 10,000 rows at most
    made = first.select("*", i.alias("i"), F.abs("amount").alias("size"))
    c = lambda field, operator, value="NULL", low="NULL", high="NULL": f"struct('{field}' AS field, '{operator}' AS operator, CAST({value} AS STRING) AS value, CAST({low} AS STRING) AS minimum, CAST({high} AS STRING) AS maximum)"
    near = lambda w: c("amount", "inRange", low=f"size - {w}", high=f"size + {w}")
    kinds = [
        (c("normalizedDescription", "equals", "normalized"), near(50)),
        (c("normalizedDescription", "startsWith", "left(normalized, 6)"), near(20)),
        (c("direction", "equals", "'outflow'"), c("accountId", "equals", "account_id")),
        (near(5),),
        (near(10), c("normalizedDescription", "contains", "substr(normalized, 2, 5)")),
        (c("tag", "equals", "'home'"), c("postedDate", "equals", "posted_date")),
    ]
    conditions = "CASE i % 6 " + " ".join(f"WHEN {k} THEN array({', '.join(v)})" for k, v in enumerate(kinds)) + " END"
    return made.select("i", F.concat(F.lit("r"), F.col("i").cast("string")).alias("rule_id"), (F.col("i") % 4).cast("int").alias("priority"), F.expr(conditions).alias("conditions"), F.lit(None).cast("string").alias("set_merchant"), F.concat(F.lit("c"), (F.col("i") % 7).cast("string")).alias("set_category"), F.lit(True).alias("enabled")).withColumnRenamed("i", "ordinal")


@register(f"{_RULE_SOURCE} SELECT txn_id, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits IS NULL THEN 'no-match' WHEN n_values > 1 THEN 'conflict' ELSE 'matched' END AS status, CASE WHEN n_values = 1 THEN category END AS category, CASE WHEN n_values = 1 THEN winner END AS winner FROM ledger LEFT JOIN found USING (txn_id)")
def rule_index_results(spark, sf_dir):
    rows = rules.prepared(L.ledger(spark, sf_dir))
    hit = rule_index.matched(rows, _many_rules(rows))
    out = rules.results(hit, F.lit(False), F.lit(False))
    return out.select("txn_id", F.size("hits").cast("long").alias("n_hits"), "category_result.status", F.col("category_result.value").alias("category"), "category_result.winner")


# Series as a stream: line items in batches by their year, against the detection of the whole.


@register(f"{_SERIES} SELECT * FROM series")
def recurring_stream_state(spark, sf_dir):
    """The state after a batch for each year of shipping."""
    path, rows = fresh(spark), L.items(spark, sf_dir)
    year = F.year("posted_date")
    last = None
    for batch, until in enumerate((1994, 1996, 9999)):
        part = rows.filter((year <= until) & (F.lit(True) if last is None else year > last))
        series.take(spark, path, "years", part, batch)
        last = until
    return series.proposals(spark, path)


# Canonical documents of orders, their digests, and back.

_AMOUNT_TEXT = "regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_DOCUMENT = f"""WITH {L.LEDGER}, docs AS (SELECT *, concat('{{"accountId":"', account_id, '","amount":"', {_AMOUNT_TEXT}, CASE WHEN category_id IS NULL THEN '' ELSE concat('","categoryId":"', category_id) END, '","classifications":{{',
  CASE WHEN category_id IS NULL THEN '' ELSE concat('"category":{{"locked":false,"value":"', category_id, '"}}') END, CASE WHEN category_id IS NULL OR merchant_id IS NULL THEN '' ELSE ',' END, CASE WHEN merchant_id IS NULL THEN '' ELSE concat('"merchant":{{"locked":false,"value":"', merchant_id, '"}}') END,
  '}},"currency":"', currency, '","description":"', description, '","id":"', txn_id, CASE WHEN merchant_id IS NULL THEN '' ELSE concat('","merchantId":"', merchant_id) END, CASE WHEN notes IS NULL THEN '' ELSE concat('","notes":"', notes) END,
  '","postedDate":"', posted_date, '","reviewState":"', review_state, '","schemaVersion":"1.0.0","status":"', status, '","tags":', CASE txn_id % 3 WHEN 0 THEN '["Home","food"]' WHEN 1 THEN '["home"]' ELSE '[]' END, '}}') AS document FROM ledger)"""


@register(f"{_DOCUMENT} SELECT txn_id, sha256(document) AS digest FROM docs")
def document_digests(spark, sf_dir):
    docs = documents.transaction_documents(L.ledger(spark, sf_dir))
    return docs.select("txn_id", F.sha2(F.col("document").cast("binary"), 256).alias("digest"))


@register(f"WITH {L.LEDGER} SELECT txn_id, account_id, posted_date, amount, currency, status, category_id, review_state, merchant_id, description, notes, array_to_string(tags, '|') AS tags FROM ledger")
def documents_round_trip(spark, sf_dir):
    rows = L.ledger(spark, sf_dir)
    back = documents.decoded(documents.transaction_documents(rows).select("document"))
    return back.filter("problem IS NULL").select(*[F.array_join("tags", "|").alias("tags") if c == "tags" else F.col(c).cast(t).alias(c) for c, t in rows.dtypes])


@register("""SELECT problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'unsupported version' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'missing amount' WHEN 3 THEN 'invalid date' WHEN 4 THEN 'invalid currency' WHEN 5 THEN 'no object' END AS problem FROM orders) GROUP BY problem""")
def documents_refused(spark, sf_dir):
    """Documents spoilt in six ways by their order's key."""
    docs = documents.transaction_documents(L.ledger(spark, sf_dir))
    swap = lambda old, new: F.regexp_replace("document", old, new)
    kind = F.col("txn_id") % 8
    spoilt = F.when(kind == 0, swap('"1.0.0"', '"1.1.0"')).when(kind == 1, F.concat("document", F.lit("}"))).when(kind == 2, swap('"amount":"[^"]*",', "")).when(kind == 3, swap('"postedDate":"[0-9-]+"', '"postedDate":"1997-02-29"')).when(kind == 4, swap('"currency":"[A-Z]+"', '"currency":"US"')).when(kind == 5, F.concat(F.lit("["), "document", F.lit("]"))).otherwise(F.col("document"))
    return documents.decoded(docs.select(spoilt.alias("document"))).groupBy("problem").agg(F.count("*").alias("n"))


# A knowledge document a nation: its customers as categories and merchants, with faults by the customer's key.

_BRAIN_SQL = """WITH c AS (SELECT c_nationkey AS nation, c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 'none' WHEN c_custkey % 50 = 8 THEN 'c' || c_custkey END AS parent FROM customer),
f AS (SELECT nation, 3 AS step, 'prohibited secrets' AS problem FROM c WHERE nation % 5 = 1 GROUP BY nation UNION ALL SELECT nation, 4, 'unsupported version' FROM c WHERE nation % 5 = 2 GROUP BY nation
UNION ALL SELECT nation, 5, 'repeated id in merchants: m' || c_custkey FROM c WHERE nation % 5 = 3 AND c_custkey % 40 = 3 UNION ALL SELECT nation, 6, 'no parentId none' FROM c WHERE parent = 'none')
SELECT nation, step, problem, CAST(count(*) AS BIGINT) AS n FROM f WHERE (nation, step) IN (SELECT (nation, min(step)) FROM f GROUP BY nation) GROUP BY ALL"""


@register(_BRAIN_SQL.replace("WHERE (nation, step) IN (SELECT (nation, min(step)) FROM f GROUP BY nation)", "JOIN (SELECT nation, min(step) AS step FROM f GROUP BY nation) USING (nation, step)"))
def brain_document_problems(spark, sf_dir):
    c = L.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_custkey").cast("string").alias("key"))
    k = F.col("c_custkey")
    category = F.struct(F.concat(F.lit("c"), "key").alias("id"), F.when(k % 50 == 7, "none").when(k % 50 == 8, F.concat(F.lit("c"), "key")).alias("parentId"))
    merchant = F.struct(F.concat(F.lit("m"), "key").alias("id"))
    lists = c.groupBy("nation").agg(F.collect_list(category).alias("categories"), F.flatten(F.collect_list(F.when((F.col("nation") % 5 == 3) & (k % 40 == 3), F.array(merchant, merchant)).otherwise(F.array(merchant)))).alias("merchants"))
    none = F.array().cast("array<struct<id:string>>")
    body = F.to_json(F.struct(F.when(F.col("nation") % 5 == 2, "2.0.0").otherwise("1.0.0").alias("schemaVersion"), *[F.lit("x").alias(x) for x in ("brainId", "createdAt", "updatedAt")], "categories", "merchants", none.alias("rules"), none.alias("recurringDecisions"), F.when(F.col("nation") % 5 == 1, "x").alias("secrets")))
    return documents.brain_problems(lists.select("nation", body.alias("body")), "nation", "body").groupBy("nation", "step", "problem").agg(F.count("*").alias("n"))


@register(f"""{_DOCUMENT}, parts AS (SELECT unnest(string_split_regex(regexp_replace(regexp_replace(document, '"(accountId|amount|categoryId|currency|description|id|merchantId|notes|postedDate|reviewState|schemaVersion|status|tags)":', '§\\1§', 'g'), '[{{}}]', '', 'g'), '§')) AS name FROM docs)
SELECT '/' || name AS path, CAST(count(*) AS BIGINT) AS n FROM parts WHERE name IN ('accountId', 'amount', 'categoryId', 'currency', 'description', 'id', 'merchantId', 'notes', 'postedDate', 'reviewState', 'schemaVersion', 'status', 'tags') GROUP BY name
UNION ALL SELECT '/classifications', count(*) FROM docs UNION ALL SELECT '/classifications/category' || x, count(category_id) FROM docs, (SELECT unnest(['', '/locked', '/value']) AS x) GROUP BY x UNION ALL SELECT '/classifications/merchant' || x, count(merchant_id) FROM docs, (SELECT unnest(['', '/locked', '/value']) AS x) GROUP BY x""")
def document_key_paths(spark, sf_dir):
    docs = documents.transaction_documents(L.ledger(spark, sf_dir))
    return documents.key_paths(docs, "txn_id", "document", documents.LEVELS).groupBy("path").agg(F.count("*").alias("n"))


@register(f"""WITH {L.LEDGER}, d AS (SELECT sha256(concat('t:', account_id, ':', posted_date)) AS d, count(*) AS n FROM ledger GROUP BY 1),
leaves AS (SELECT left(d, 6) AS leaf, sha256(string_agg(d || ':' || n, ',' ORDER BY d || ':' || n)) AS digest FROM d GROUP BY 1),
branches AS (SELECT left(leaf, 3) AS branch, count(*) AS n, sha256(string_agg(leaf || ':' || digest, ',' ORDER BY leaf)) AS digest FROM leaves GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_leaves, sha256(string_agg(branch || ':' || digest, ',' ORDER BY branch)) AS digest FROM branches""")
def revision_digest(spark, sf_dir):
    """The digest of all (account, day) keys of the ledger."""
    rows = L.ledger(spark, sf_dir)
    return documents.revision(rows, F.concat(F.lit("t:"), F.col("account_id").cast("string"), F.lit(":"), F.col("posted_date").cast("string")))
