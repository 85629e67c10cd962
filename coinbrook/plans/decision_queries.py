"""Drafts, commits, evaluations, previews and projected decisions over the tables, with SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.operators import duplicates, knowledge, rules
from coinbrook.plans import ledgers as L
from coinbrook.plans import match_queries as M
from coinbrook.sources import mapping

QUERIES: dict = {}


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


# Drafts

_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {t})"
_DRAFT = {
    "posted_date": "CASE o_orderkey % 11 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-2-3' ELSE CAST(CAST(o_orderdate AS DATE) AS {t}) END",
    "transaction_date": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '2026-13-01' END",
    "description": "CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN repeat('d', 1001) ELSE o_orderpriority END",
    "amount": f"CASE o_orderkey % 5 WHEN 0 THEN concat({_MONEY}, '0') WHEN 1 THEN concat('+', {_MONEY}) WHEN 2 THEN concat('-', {_MONEY}) ELSE {_MONEY} END",
    "currency": "CASE o_orderkey % 17 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN NULL ELSE 'USD' END",
    "source_id": "CASE o_orderkey % 19 WHEN 0 THEN repeat('i', 241) WHEN 1 THEN NULL ELSE 'F1' END",
}
_DRAFTS = "WITH drafts AS (SELECT o_orderkey AS draft_id, {} FROM orders)".format(", ".join(f"{e.format(t='VARCHAR')} AS {c}" for c, e in _DRAFT.items()))
_CHECKED = f"""{_DRAFTS}, bad AS (SELECT draft_id, field FROM (SELECT draft_id, unnest(['posted_date', 'transaction_date', 'description', 'amount', 'currency', 'source_id']) AS field,
  unnest([draft_id % 11 < 2, draft_id % 3 = 1, draft_id % 13 < 2, draft_id % 5 < 2, draft_id % 17 < 3, draft_id % 19 = 0]) AS is_bad FROM drafts) WHERE is_bad)"""


def _drafts(spark, sf_dir) -> DataFrame:
    raw = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draft_id"), *[F.expr(e.format(t="STRING")).alias(c) for c, e in _DRAFT.items()])
    return mapping.checked_drafts(raw, "USD")


@register(f"{_CHECKED} SELECT draft_id, field FROM bad")
def draft_problems(spark, sf_dir):
    return _drafts(spark, sf_dir).select("draft_id", F.explode("bad").alias("field"))


@register(f"""{_CHECKED}, good AS (SELECT CAST(amount AS DECIMAL(38,2)) AS v FROM drafts WHERE draft_id NOT IN (SELECT draft_id FROM bad))
SELECT CAST(coalesce(sum(v) FILTER (v > 0), 0) AS DECIMAL(38,2)) AS inflow, CAST(coalesce(-sum(v) FILTER (v < 0), 0) AS DECIMAL(38,2)) AS outflow, CAST(count(*) AS BIGINT) AS valid_rows, CAST((SELECT count(*) FROM drafts) - count(*) AS BIGINT) AS invalid_rows, (SELECT count(*) FROM drafts) = count(*) AS can_continue FROM good""")
def draft_totals(spark, sf_dir):
    return mapping.draft_totals(_drafts(spark, sf_dir))


# Commits: a file a customer, a candidate an order.

_SOURCES = "CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'csv' END AS parser_id, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS n_errors"


@register("""WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(n, 0) + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS source_rows FROM customer LEFT JOIN n ON k = c_custkey WHERE c_custkey % 10 <> 1),
ids AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN 'F' || (o_orderkey - CASE WHEN o_orderkey % 100 = 3 THEN 1 ELSE 0 END) END AS id FROM orders)
SELECT 'source twice' AS problem, CAST(k AS VARCHAR) AS subject, CAST(2 AS BIGINT) AS n FROM s WHERE k % 8 = 0
UNION ALL SELECT 'source with errors', CAST(k AS VARCHAR), 1 FROM s WHERE k % 9 = 0
UNION ALL SELECT 'other account', NULL, count(*) FROM orders WHERE o_orderkey % 30 = 1 HAVING count(*) > 0
UNION ALL SELECT 'other currency', NULL, count(*) FROM orders WHERE o_orderkey % 40 = 2 HAVING count(*) > 0
UNION ALL SELECT 'source not selected', CAST(k AS VARCHAR), n FROM n WHERE k % 10 = 1
UNION ALL SELECT 'other parser', CAST(k AS VARCHAR), n FROM s WHERE k % 7 = 0 AND n > 0
UNION ALL SELECT 'identifier twice', id, count(*) FROM ids WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'rows are not candidates one to one', CAST(k AS VARCHAR), n FROM s WHERE n <> source_rows""")
def commit_problems(spark, sf_dir):
    """Customers in ten lack their file, others have it twice, with errors, by another parser or with a row more."""
    o, c = L.table(spark, sf_dir, "orders"), L.table(spark, sf_dir, "customer")
    identifier = "CASE WHEN o_orderkey % 50 <> 0 THEN concat('F', o_orderkey - CASE WHEN o_orderkey % 100 = 3 THEN 1 ELSE 0 END) END"
    made = o.selectExpr("CAST(o_custkey AS STRING) AS sha256", "CASE WHEN o_orderkey % 30 = 1 THEN 'b' ELSE 'a' END AS account_id", "CASE WHEN o_orderkey % 40 = 2 THEN NULL ELSE 'USD' END AS currency", "'csv' AS parser_id", "'1' AS parser_version", f"{identifier} AS source_id")
    sizes = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    files = c.filter("c_custkey % 10 <> 1").join(sizes, "c_custkey", "left").selectExpr("c_custkey", "CAST(c_custkey AS STRING) AS sha256", *_SOURCES.split(", "), "'1' AS parser_version", "coalesce(n, 0) + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS source_rows")
    return mapping.commit_problems(made, files.unionByName(files.filter("c_custkey % 8 = 0")), "a", "USD")


# Evaluations: a run a priority, a case an order.

_EVAL = """WITH o AS (SELECT o_orderpriority AS run, o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'invalidOutput' ELSE 'answered' END WHEN 1 THEN 'abstained' WHEN 2 THEN 'abstained' ELSE 'answered' END AS kind, CASE WHEN o_orderpriority = '3-MEDIUM' THEN TRUE ELSE o_orderkey % 10 > 0 END AS correct,
  o_orderpriority = '2-HIGH' AND o_orderkey % 100 = 2 AS privacy, CASE WHEN o_orderpriority = '5-LOW' THEN 100 ELSE 1 END * (o_orderkey % 90) AS latency, o_orderkey % 7 IN (1, 2) AND (o_orderpriority <> '4-NOT SPECIFIED' OR o_orderkey % 2 = 0) OR o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 7 = 3 AS expected FROM orders),
m AS (SELECT run, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT expected) AS BIGINT) AS answerable, CAST(count(*) FILTER (expected) AS BIGINT) AS should_abstain, CAST(count(*) FILTER (kind = 'abstained') AS BIGINT) AS did_abstain,
  count(*) FILTER (kind <> 'invalidOutput') / count(*) AS valid_rate, count(*) FILTER (kind = 'invalidOutput') / count(*) AS invalid_rate, coalesce(count(*) FILTER (NOT expected AND correct) / nullif(count(*) FILTER (NOT expected), 0), 0) AS accuracy,
  coalesce(count(*) FILTER (expected AND kind = 'abstained') / nullif(count(*) FILTER (kind = 'abstained'), 0), 0) AS abstention_precision, coalesce(count(*) FILTER (expected AND kind = 'abstained') / nullif(count(*) FILTER (expected), 0), 0) AS abstention_recall,
  CAST(0 AS BIGINT) AS grounding_violations, CAST(count(*) FILTER (privacy) AS BIGINT) AS privacy_violations, list_sort(list(latency))[least(count(*), count(*) // 2 + 1)] AS latency_median, list_sort(list(latency))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS latency_p95 FROM o GROUP BY run)"""


def _evaluated(spark, sf_dir) -> DataFrame:
    o = L.table(spark, sf_dir, "orders").withColumns({"run": F.col("o_orderpriority"), "case_id": F.col("o_orderkey")})
    kind = "CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN run = '1-URGENT' THEN 'invalidOutput' ELSE 'answered' END WHEN 1 THEN 'abstained' WHEN 2 THEN 'abstained' ELSE 'answered' END AS kind"
    outcomes = o.selectExpr("run", "case_id", kind, "CASE WHEN run = '3-MEDIUM' THEN TRUE ELSE o_orderkey % 10 > 0 END AS correct", "CAST(NULL AS BOOLEAN) AS grounding_violation", "run = '2-HIGH' AND o_orderkey % 100 = 2 AS privacy_violation", "CASE WHEN run = '5-LOW' THEN 100 ELSE 1 END * (o_orderkey % 90) AS latency_ms")
    cases = o.selectExpr("run", "case_id", "o_orderkey % 7 IN (1, 2) AND (run <> '4-NOT SPECIFIED' OR o_orderkey % 2 = 0) OR run = '4-NOT SPECIFIED' AND o_orderkey % 7 = 3 AS expected_abstention")
    return knowledge.evaluation(outcomes, cases)


@register(f"{_EVAL} SELECT * FROM m")
def evaluation_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@register(f"""{_EVAL} SELECT run, CASE WHEN privacy_violations > 0 OR invalid_rate > 0.02 THEN 'failed' WHEN accuracy < 0.8 OR abstention_recall < 0.7 OR latency_p95 > 2000 THEN 'experimental' ELSE 'supported' END AS status,
array_to_string(CASE WHEN privacy_violations > 0 OR invalid_rate > 0.02 THEN list_concat(CASE WHEN privacy_violations > 0 THEN ['privacy_violations'] ELSE [] END, CASE WHEN invalid_rate > 0.02 THEN ['invalid_rate'] ELSE [] END)
ELSE list_concat(list_concat(CASE WHEN accuracy < 0.8 THEN ['accuracy'] ELSE [] END, CASE WHEN abstention_recall < 0.7 THEN ['abstention_recall'] ELSE [] END), CASE WHEN latency_p95 > 2000 THEN ['latency_p95'] ELSE [] END) END, ',') AS failures FROM m""")
def evaluation_gates(spark, sf_dir):
    """Five runs: unsafe ones, a slow one, one that abstains too rarely and one that clears all."""
    return knowledge.evaluation_gates(_evaluated(spark, sf_dir)).withColumn("failures", F.array_join("failures", ","))


# Previews, suggestions and account types


@register(f"""{M._RULES}, r AS (SELECT merchant_status AS a, CASE WHEN txn_id % 8 = 0 THEN 'locked' ELSE category_status END AS b FROM results)
SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER ('matched' IN (a, b)) AS BIGINT) AS n_matched, CAST(count(*) FILTER ('locked' IN (a, b)) AS BIGINT) AS n_locked, CAST(count(*) FILTER ('conflict' IN (a, b)) AS BIGINT) AS n_conflict FROM r""")
def rules_preview_counts(spark, sf_dir):
    return rules.impact_preview(M._hits(spark, sf_dir), F.col("merchant_id").isNotNull(), F.col("txn_id") % 8 == 0, F.col("txn_id"))[0]


@register(f"{M._RULES} SELECT txn_id, merchant_status, CASE WHEN txn_id % 8 = 0 THEN 'locked' ELSE category_status END AS category_status FROM results ORDER BY txn_id LIMIT 20")
def rules_preview_samples(spark, sf_dir):
    rows = rules.impact_preview(M._hits(spark, sf_dir), F.col("merchant_id").isNotNull(), F.col("txn_id") % 8 == 0, F.col("txn_id"))[1]
    return rows.select("txn_id", F.col("merchant_result.status").alias("merchant_status"), F.col("category_result.status").alias("category_status"))


_REJECTED = "(SELECT normalized FROM n WHERE txn_id % 997 = 5)"


@register(f"{M._QUEUE} SELECT q.txn_id, reason FROM queue q JOIN n ON n.txn_id = q.txn_id WHERE reason IS NOT NULL AND status <> 'void' AND q.txn_id % 8 <> 0 AND merchant_id IS NULL AND normalized NOT IN {_REJECTED}")
def suggestions_eligible(spark, sf_dir):
    """Rows of the review queue with neither lock; descriptions that were rejected for this version are out, those of another version are not."""
    rows = rules.prepared(L.ledger(spark, sf_dir)).withColumns({"category_locked": F.col("txn_id") % 8 == 0, "merchant_locked": F.col("merchant_id").isNotNull()})
    queue = M._queue(spark, sf_dir).select("txn_id", "reason").join(rows.select("txn_id", "status", "normalized", "category_locked", "merchant_locked"), "txn_id")
    rejected = rows.filter("txn_id % 997 in (5, 6)").select("normalized", F.when(F.col("txn_id") % 997 == 5, "v2").otherwise("v1").alias("classifier_version"))
    return knowledge.queue_eligible(queue, rejected, "v2").select("txn_id", "reason")


@register(f"WITH {L.LEDGER} SELECT txn_id FROM ledger LEFT JOIN customer ON c_custkey = account_id WHERE CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 2 = 0 THEN 'savings' ELSE 'checking' END = 'checking'")
def rules_by_account_type(spark, sf_dir):
    """A rule for checking accounts; accounts that are not known count as such."""
    rows = rules.prepared(L.ledger(spark, sf_dir), L.accounts(spark, sf_dir))
    rule = rules.Rule("c", "checking", 1, (rules.Condition("accountType", "equals", "checking"),), set_category="household")
    return rules.rule_matches(rules.matched(rows, [rule])).select("txn_id")


# Decisions about duplicates, projected on the ledger they are about.


@register(f"""{M._BATCHES}, d AS (SELECT * FROM candidates WHERE existing_id % 7 <> 0 AND existing_id % 40 <> 0), s AS (SELECT existing_id AS id, existing_id % 3 = 1 AS gone FROM d UNION ALL SELECT incoming_id, existing_id % 3 = 0 FROM d), g AS (SELECT id, bool_or(gone) AS gone FROM s GROUP BY id)
SELECT txn_id, CASE WHEN gone THEN 'void' ELSE status END AS status, CASE WHEN id IS NOT NULL THEN 'reviewed' ELSE review_state END AS review_state FROM (SELECT txn_id, status, review_state FROM ledger UNION ALL SELECT txn_id + 100000000, status, review_state FROM ledger) LEFT JOIN g ON id = txn_id""")
def duplicates_projected(spark, sf_dir):
    old, new = M._batches(spark, sf_dir)
    found = duplicates.candidates(old, new)
    return duplicates.project(old.unionByName(new), found, M._events(found)).select("txn_id", "status", "review_state")
