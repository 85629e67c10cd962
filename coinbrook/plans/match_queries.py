"""Merchants, recurring series, transfers, duplicates, rules, knowledge and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.operators import cashflow, duplicates, knowledge, merchants, recurring, rules, transfers
from coinbrook.plans import ledgers as L
from coinbrook.plans.cash_queries import SUMS, WITH
from coinbrook.plans.text_queries import PLAIN, dice_sql, fingerprint_sql, merchant_sql, tokens_sql

QUERIES: dict = {}


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


# Merchants

_MATCH = f"""norm AS (SELECT DISTINCT description, {merchant_sql('description')} AS normalized FROM ledger),
matches AS (SELECT DISTINCT n.description, n.normalized, a.merchant_id, a.merchant_name, a.ordinal FROM norm n JOIN aliases a ON NOT a.archived AND a.redirect_to IS NULL AND
  CASE a.match_mode WHEN 'exact' THEN n.normalized = a.pattern WHEN 'tokenPrefix' THEN n.normalized = a.pattern OR starts_with(n.normalized, a.pattern || ' ') ELSE contains(n.normalized, a.pattern) END),
firsts AS (SELECT description, arg_min(merchant_id, ordinal) AS matched_id, arg_min(merchant_name, ordinal) AS matched_name, CAST(count(*) AS BIGINT) AS n_merchants FROM matches GROUP BY description)"""
MERCHANTS = f"WITH {L.LEDGER}, {L.ALIASES}, {_MATCH}"
_SPENT = f"""{MERCHANTS}, trend AS (SELECT currency, coalesce(matched_id, 'unresolved') AS matched_id, coalesce(matched_name, 'Unresolved Merchants') AS matched_name, strftime(posted_date, '%Y-%m') AS month, CAST(sum(-amount) AS DECIMAL(38,2)) AS spending, CAST(count(*) AS BIGINT) AS n_transactions
  FROM ledger LEFT JOIN firsts USING (description) WHERE status = 'posted' AND amount < 0 AND txn_id % 50 <> 1 GROUP BY ALL)"""


@register(f"{MERCHANTS} SELECT description, normalized, merchant_id FROM matches")
def alias_match(spark, sf_dir):
    return merchants.alias_matches(L.ledger(spark, sf_dir), L.aliases(spark)).select("description", "normalized", "merchant_id")


@register(f"{MERCHANTS} SELECT description, matched_id, n_merchants FROM firsts WHERE n_merchants > 1")
def alias_collisions(spark, sf_dir):
    return merchants.first_merchant(merchants.alias_matches(L.ledger(spark, sf_dir), L.aliases(spark))).filter("n_merchants > 1").select("description", "matched_id", "n_merchants")


def _trend(spark, sf_dir) -> DataFrame:
    rows = L.ledger(spark, sf_dir)
    return merchants.monthly_trend(rows, L.aliases(spark), L.linked_ids(rows))


@register(f"{_SPENT} SELECT * FROM trend")
def merchant_monthly_trend(spark, sf_dir):
    return _trend(spark, sf_dir)


@register(f"{_SPENT} SELECT currency, matched_id, matched_name, CAST(sum(spending) AS DECIMAL(38,2)) AS spending, CAST(sum(n_transactions) AS BIGINT) AS n_transactions, CAST(count(*) AS BIGINT) AS n_months FROM trend GROUP BY ALL")
def merchant_ranking(spark, sf_dir):
    return merchants.ranking(_trend(spark, sf_dir))


@register(f"{_SPENT} SELECT currency, CAST(sum(spending) AS DECIMAL(38,2)) AS spending, CAST(sum(n_transactions) AS BIGINT) AS n_transactions FROM trend WHERE matched_id = 'unresolved' GROUP BY currency")
def merchant_unresolved(spark, sf_dir):
    return merchants.ranking(_trend(spark, sf_dir)).filter("matched_id = 'unresolved'").select("currency", "spending", "n_transactions")


@register("SELECT 'n' || n_nationkey AS merchant_id, 'n' || CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey ELSE n_nationkey - n_nationkey % 5 + 4 END AS final_id FROM nation WHERE n_nationkey % 5 <> 9")
def merchant_redirects(spark, sf_dir):
    n = L.table(spark, sf_dir, "nation").select("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    key = F.col("n_nationkey")
    return merchants.follow_redirects(n.select(name(key).alias("merchant_id"), F.when(key % 5 != 4, name(key + 1)).alias("redirect_to")))


# Recurring series

_SERIES = f"""WITH {L.ITEMS}, e AS (SELECT trim(regexp_replace(regexp_replace(upper(description), '[0-9]', '', 'g'), '\\s+', ' ', 'g')) AS name, currency, posted_date, -amount AS size FROM items WHERE status = 'posted' AND amount < 0),
g AS (SELECT name, currency, CAST(count(*) AS BIGINT) AS members, min(posted_date) AS first_seen, max(posted_date) AS last_seen, CAST(min(size) AS DECIMAL(38,2)) AS least, CAST(max(size) AS DECIMAL(38,2)) AS most, CAST(list_sort(list(size))[count(*) // 2 + 1] AS DECIMAL(38,2)) AS median FROM e GROUP BY name, currency HAVING count(*) >= 3),
c AS (SELECT *, CASE WHEN avg_gap BETWEEN 5 AND 9 THEN 'weekly' WHEN avg_gap BETWEEN 11 AND 17 THEN 'biweekly' WHEN avg_gap BETWEEN 26 AND 35 THEN 'monthly' WHEN avg_gap BETWEEN 80 AND 100 THEN 'quarterly' WHEN avg_gap BETWEEN 340 AND 390 THEN 'yearly' ELSE 'irregular' END AS cadence FROM (SELECT *, (last_seen - first_seen) / (members - 1) AS avg_gap FROM g)),
series AS (SELECT lower(name || ':' || currency) || ':' || currency || ':' || cadence AS signature, name, currency, cadence, members, first_seen, last_seen, last_seen + CASE cadence WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 91 ELSE 365 END AS next_expected, least, most, median, least <> most AS is_variable, CAST(CASE WHEN least <> most THEN 0.85 ELSE 0.95 END AS DOUBLE) AS confidence FROM c WHERE cadence <> 'irregular'),
decisions AS (SELECT signature, CASE members % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' ELSE 'muted' END AS status FROM series WHERE members % 4 < 3)"""


@register(f"{_SERIES} SELECT * FROM series")
def recurring_proposals(spark, sf_dir):
    return recurring.proposals(L.items(spark, sf_dir))


@register(f"{_SERIES} SELECT name, currency, CAST(list_sort(list(size))[count(*) // 2 + 1] AS DECIMAL(38,2)) AS median FROM e GROUP BY name, currency")
def recurring_upper_median(spark, sf_dir):
    rows = recurring.eligible(L.items(spark, sf_dir)).withColumn("size", F.abs("amount"))
    return recurring.upper_medians(rows, ["name", "currency"], "size").withColumn("median", F.col("median").cast("decimal(38,2)"))


@register(f"{_SERIES} SELECT name, currency, posted_date, CAST(posted_date - lag(posted_date) OVER (PARTITION BY name, currency ORDER BY posted_date) AS INTEGER) AS gap FROM (SELECT DISTINCT name, currency, posted_date FROM e)")
def recurring_gaps(spark, sf_dir):
    return recurring.gaps(L.items(spark, sf_dir))


def _decisions(found: DataFrame) -> DataFrame:
    m = F.col("members") % 4
    return found.filter(m < 3).select("signature", F.lit(1).alias("ordinal"), F.when(m == 0, "confirmed").when(m == 1, "dismissed").otherwise("muted").alias("status"))


@register(
    f"{_SERIES}, s AS (SELECT series.*, coalesce(d.status, 'proposed') AS status FROM series LEFT JOIN decisions d USING (signature)) SELECT currency, CAST(sum(CASE WHEN status = 'confirmed' THEN median ELSE 0 END) AS DECIMAL(38,2)) AS confirmed_spend, {', '.join(f'''CAST(count(*) FILTER (status = '{x}') AS BIGINT) AS n_{x}''' for x in ('confirmed', 'proposed', 'dismissed', 'muted'))}, CAST(count(*) AS BIGINT) AS n_series FROM s GROUP BY currency"
)
def recurring_summary(spark, sf_dir):
    found = recurring.proposals(L.items(spark, sf_dir))
    return recurring.summary(found, _decisions(found))


@register(f"{_SERIES} SELECT signature FROM series WHERE members % 4 = 3")
def recurring_unresolved(spark, sf_dir):
    found = recurring.proposals(L.items(spark, sf_dir))
    return recurring.unresolved(found, _decisions(found)).select("signature")


def _plans(rows: DataFrame) -> DataFrame:
    """The ledger with one series for each account and currency."""
    return rows.withColumn("description", F.concat(F.lit("plan "), F.translate(F.col("account_id").cast("string"), "0123456789", "ABCDEFGHIJ")))


_PLAN = f"""{_SERIES.replace(L.ITEMS, L.LEDGER + ", items AS (SELECT posted_date, amount, currency, status, 'plan ' || translate(CAST(account_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS description FROM ledger)")}"""


@register(f"{_PLAN} SELECT signature, members, last_seen, median FROM series")
def recurring_incremental_equals_full(spark, sf_dir):
    """Series of every account, from those without the rows since 2000 and the groups that these touch."""
    return _incremental(_plans(L.ledger(spark, sf_dir)))


def _incremental(rows: DataFrame) -> DataFrame:
    old = recurring.proposals(rows.filter("posted_date < '2000-01-01'"))
    return recurring.recompute(rows, old, rows.filter("posted_date >= '2000-01-01'")).select("signature", "members", "last_seen", "median")


#: The same under the name by which its rows over every account were first listed.
QUERIES["recurring_incremental_whole_ledger"] = QUERIES["recurring_incremental_equals_full"]


@register(f"WITH {L.LEDGER}, d AS (SELECT txn_id AS decision_id, CASE WHEN txn_id % 12 = 0 THEN 'recurring-v0' ELSE 'recurring-v1' END AS version FROM ledger WHERE txn_id % 4 = 0) SELECT d.decision_id FROM d WHERE version <> 'recurring-v1' OR decision_id IN (SELECT txn_id FROM ledger WHERE status <> 'posted')")
def recurring_reconcile(spark, sf_dir):
    rows = L.ledger(spark, sf_dir)
    own = rows.filter("txn_id % 4 = 0").select(F.col("txn_id").alias("decision_id"))
    made = own.withColumns({"status": F.lit("confirmed"), "detector_version": F.when(F.col("decision_id") % 12 == 0, "recurring-v0").otherwise("recurring-v1")})
    return recurring.stale(made, own.withColumn("txn_id", F.col("decision_id")), rows).select("decision_id")


# Transfers

_PAIRS = f"""WITH {L.LEDGER}, p AS (SELECT o.txn_id AS outflow_id, i.txn_id AS inflow_id, o.currency, abs(o.posted_date - i.posted_date) AS days, abs(abs(o.amount) - i.amount) AS diff FROM ledger o JOIN ledger i ON o.currency = i.currency AND o.account_id <> i.account_id AND abs(o.posted_date - i.posted_date) <= 3 AND abs(abs(o.amount) - i.amount) <= 1000 WHERE o.status = 'posted' AND i.status = 'posted' AND o.amount < 0 AND i.amount >= 0),
pairs AS (SELECT CASE WHEN CAST(outflow_id AS VARCHAR) < CAST(inflow_id AS VARCHAR) THEN outflow_id || ':' || inflow_id ELSE inflow_id || ':' || outflow_id END AS signature, outflow_id, inflow_id, currency, CAST(days AS INTEGER) AS days, CASE WHEN diff > 0 THEN CAST(diff AS DECIMAL(38,2)) END AS fee, CAST(7000 - 300 * days + CASE WHEN diff = 0 THEN 5000 ELSE 2000 END AS INTEGER) AS score, count(*) OVER (PARTITION BY outflow_id) > 1 OR count(*) OVER (PARTITION BY inflow_id) > 1 AS is_ambiguous FROM p)"""


@register(f"{_PAIRS} SELECT * FROM pairs")
def transfer_pairs(spark, sf_dir):
    return transfers.pairs(L.ledger(spark, sf_dir), max_fee="1000")


@register(f"{_PAIRS} SELECT is_ambiguous, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY is_ambiguous")
def transfer_ambiguity(spark, sf_dir):
    return transfers.pairs(L.ledger(spark, sf_dir), max_fee="1000").groupBy("is_ambiguous").agg(F.count("*").alias("n"))


@register(f"{_PAIRS} SELECT signature FROM pairs WHERE outflow_id % 3 <> 0")
def transfer_unresolved(spark, sf_dir):
    found = transfers.pairs(L.ledger(spark, sf_dir), max_fee="1000")
    links = found.filter("outflow_id % 3 = 0").select("signature", F.when(F.col("outflow_id") % 2 == 0, "confirmed").otherwise("rejected").alias("status"))
    return transfers.unresolved(found, links).select("signature")


# Duplicates

_BATCHES = f"""WITH {L.LEDGER}, existing AS (SELECT txn_id, account_id, currency, amount, posted_date, description, CASE WHEN txn_id % 40 = 0 THEN 'S' || txn_id END AS source_id FROM ledger),
incoming AS (SELECT txn_id + 100000000 AS txn_id, account_id, currency, amount, posted_date + CAST(txn_id % 5 AS INTEGER) AS posted_date, CASE WHEN txn_id % 60 = 0 THEN 'something else' ELSE description || ' copy' END AS description, CASE WHEN txn_id % 40 = 0 THEN 'S' || txn_id END AS source_id FROM ledger),
e AS (SELECT *, {fingerprint_sql(PLAIN)} AS fp, {tokens_sql('description')} AS words FROM existing), i AS (SELECT *, {fingerprint_sql(PLAIN)} AS fp, {tokens_sql('description')} AS words FROM incoming),
b AS (SELECT e.txn_id AS existing_id, i.txn_id AS incoming_id, coalesce(e.source_id = i.source_id, FALSE) OR e.fp = i.fp AS exact, e.currency = i.currency AND e.amount = i.amount AS same, abs(e.posted_date - i.posted_date) AS days, {dice_sql('e.words', 'i.words')} AS similarity
  FROM e JOIN i ON e.account_id = i.account_id AND (e.source_id = i.source_id OR e.fp = i.fp OR e.currency = i.currency AND e.amount = i.amount) WHERE e.txn_id <> i.txn_id),
candidates AS (SELECT existing_id, incoming_id, CASE WHEN exact THEN 'exact' ELSE 'likely' END AS kind, CAST(CASE WHEN exact THEN 10000 ELSE 4000 + greatest(0, 2500 - 500 * days) + floor(3500 * CAST(similarity AS DOUBLE) + 0.5) END AS INTEGER) AS score, CAST(days AS INTEGER) AS days, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM b WHERE exact OR same AND days <= 3 AND similarity >= 0.5)"""


def _batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The ledger and a changed copy of each of its rows as the incoming batch."""
    rows = L.ledger(spark, sf_dir).withColumn("source_id", F.when(F.col("txn_id") % 40 == 0, F.concat(F.lit("S"), F.col("txn_id").cast("string"))))
    changed = F.when(F.col("txn_id") % 60 == 0, "something else").otherwise(F.concat("description", F.lit(" copy")))
    new = rows.withColumns({"posted_date": F.date_add("posted_date", (F.col("txn_id") % 5).cast("int")), "description": changed, "txn_id": F.col("txn_id") + 100_000_000})
    return rows, new


@register(f"{_BATCHES} SELECT existing_id, incoming_id FROM b")
def duplicate_blocking(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return duplicates.blocked(duplicates.with_keys(old), duplicates.with_keys(new))


@register(f"{_BATCHES} SELECT * FROM candidates")
def duplicate_candidates(spark, sf_dir):
    return duplicates.candidates(*_batches(spark, sf_dir))


QUERIES["duplicate_candidates_whole_ledger"] = QUERIES["duplicate_candidates"]


def _events(found: DataFrame) -> DataFrame:
    """A decision on each candidate: every seventh is undone, some were made on other evidence."""
    signed = duplicates.evidence_signature(found)
    k = F.col("existing_id")
    action = F.when(k % 3 == 0, "keep-existing").when(k % 3 == 1, "keep-new").otherwise("manual-link")
    old = F.when(k % 40 == 0, "old evidence").otherwise(F.col("evidence_signature"))
    made = signed.select(F.lit("decision").alias("type"), F.concat(F.lit("e"), F.col("candidate_id")).alias("event_id"), "candidate_id", old.alias("evidence_signature"), action.alias("action"), F.lit(None).cast("string").alias("decision_id"))
    undo = signed.filter(k % 7 == 0).select(F.lit("undo").alias("type"), F.concat(F.lit("u"), F.col("candidate_id")).alias("event_id"), *[F.lit(None).cast("string").alias(c) for c in ("candidate_id", "evidence_signature", "action")], F.concat(F.lit("e"), F.col("candidate_id")).alias("decision_id"))
    return made.unionByName(undo)


@register(f"{_BATCHES} SELECT existing_id || ':' || incoming_id AS candidate_id, CASE existing_id % 3 WHEN 0 THEN 'keep-existing' WHEN 1 THEN 'keep-new' ELSE 'manual-link' END AS action FROM candidates WHERE existing_id % 7 <> 0")
def duplicate_active_decisions(spark, sf_dir):
    found = duplicates.candidates(*_batches(spark, sf_dir))
    return duplicates.active_decisions(_events(found)).select("candidate_id", "action")


@register(
    f"{_BATCHES} SELECT DISTINCT CASE existing_id % 3 WHEN 0 THEN 'suppress-incoming' WHEN 1 THEN 'suppress-existing' ELSE 'linked' END AS effect, CASE existing_id % 3 WHEN 0 THEN CAST(incoming_id AS VARCHAR) WHEN 1 THEN CAST(existing_id AS VARCHAR) ELSE existing_id || ':' || incoming_id END AS subject FROM candidates WHERE existing_id % 7 <> 0 AND existing_id % 40 <> 0"
)
def duplicate_effects(spark, sf_dir):
    found = duplicates.candidates(*_batches(spark, sf_dir))
    return duplicates.effects(found, _events(found))


# Rules

_NORM = merchant_sql("description")
_RULES = f"""WITH {L.LEDGER}, n AS (SELECT *, {_NORM} AS normalized, abs(amount) AS size FROM ledger),
hits AS (SELECT txn_id, 'r1' AS rule_id, 10 AS priority, 5 AS specificity, NULL AS merchant, 'small' AS category FROM n WHERE size BETWEEN 0 AND 50000
  UNION ALL SELECT txn_id, 'r2', 10, 5, NULL, 'cars' FROM n WHERE starts_with(normalized, 'automobile')
  UNION ALL SELECT txn_id, 'r3', 20, 20, 'payer', 'income' FROM n WHERE amount >= 0 AND list_contains(tags, 'home')
  UNION ALL SELECT txn_id, 'r4', 5, 2, 'urgency', NULL FROM n WHERE contains(normalized, 'urgent')
  UNION ALL SELECT txn_id, 'r6', 10, 5, NULL, 'large' FROM n WHERE size BETWEEN 40000 AND 400000),
cat AS (SELECT txn_id, category, rank() OVER (PARTITION BY txn_id ORDER BY priority DESC, specificity DESC) AS k, rule_id FROM hits WHERE category IS NOT NULL),
cat_result AS (SELECT txn_id, CASE WHEN count(DISTINCT category) > 1 THEN 'conflict' ELSE 'matched' END AS status, CASE WHEN count(DISTINCT category) = 1 THEN min(category) END AS value, CASE WHEN count(DISTINCT category) = 1 THEN min(rule_id) END AS winner FROM cat WHERE k = 1 GROUP BY txn_id),
mer AS (SELECT txn_id, merchant, rank() OVER (PARTITION BY txn_id ORDER BY priority DESC, specificity DESC) AS k FROM hits WHERE merchant IS NOT NULL),
mer_result AS (SELECT txn_id, CASE WHEN count(DISTINCT merchant) > 1 THEN 'conflict' ELSE 'matched' END AS status, CASE WHEN count(DISTINCT merchant) = 1 THEN min(merchant) END AS value FROM mer WHERE k = 1 GROUP BY txn_id),
results AS (SELECT n.*, coalesce(c.status, 'no-match') AS category_status, c.value AS category_value, c.winner, CASE WHEN merchant_id IS NOT NULL THEN 'locked' ELSE coalesce(m.status, 'no-match') END AS merchant_status, CASE WHEN merchant_id IS NULL THEN m.value END AS merchant_value FROM n LEFT JOIN cat_result c USING (txn_id) LEFT JOIN mer_result m USING (txn_id))"""


def _hits(spark, sf_dir) -> DataFrame:
    return rules.matched(rules.prepared(L.ledger(spark, sf_dir)), L.RULES)


@register(f"{_RULES} SELECT txn_id, rule_id, priority, specificity FROM hits")
def rule_matches(spark, sf_dir):
    return rules.rule_matches(_hits(spark, sf_dir))


@register(f"{_RULES} SELECT txn_id, rule_id FROM cat WHERE k = 1")
def rule_top_tier(spark, sf_dir):
    rows = rules.results(_hits(spark, sf_dir), F.lit(False), F.lit(False)).select("txn_id", "hits", F.filter("hits", lambda h: h["category"].isNotNull()).alias("own"))
    tier = lambda h: h["priority"] * 1000 + h["specificity"]
    top = F.filter("own", lambda h: tier(h) == F.array_max(F.transform("own", tier)))
    return rows.select("txn_id", F.explode(top).alias("h")).select("txn_id", "h.rule_id")


@register(f"{_RULES} SELECT txn_id, category_status, category_value, winner, merchant_status, merchant_value FROM results")
def rule_results(spark, sf_dir):
    out = rules.results(_hits(spark, sf_dir), F.col("merchant_id").isNotNull(), F.lit(False))
    c, m = "category_result", "merchant_result"
    return out.select("txn_id", F.col(f"{c}.status").alias("category_status"), F.col(f"{c}.value").alias("category_value"), F.col(f"{c}.winner").alias("winner"), F.col(f"{m}.status").alias("merchant_status"), F.col(f"{m}.value").alias("merchant_value"))


@register(f"{_RULES} SELECT CAST(count(*) AS BIGINT) AS n_matched, CAST(count(*) FILTER (review_state = 'reviewed') AS BIGINT) AS n_locked, CAST(count(*) FILTER (category_status = 'conflict') AS BIGINT) AS n_conflict FROM results WHERE txn_id IN (SELECT txn_id FROM hits WHERE rule_id = 'r1')")
def rule_impact_preview(spark, sf_dir):
    return rules.impact(_hits(spark, sf_dir), "r1", F.col("review_state") == "reviewed")


@register("SELECT * FROM (VALUES ('x1', 'x2', 'shadowed'), ('x2', 'x1', 'overlapping')) AS t(rule_a, rule_b, overlap)")
def rule_overlap(spark, sf_dir):
    one = (rules.Condition("amount", "equals", "5"),)
    return rules.overlaps(spark, [rules.Rule("x1", "a", 5, one), rules.Rule("x2", "b", 4, one), *L.RULES])


_QUEUE = f"""{_RULES.replace('WITH ', f'WITH {L.ALIASES}, ', 1)}, {_MATCH}, queue AS (SELECT txn_id, account_id, posted_date, CASE WHEN category_status = 'conflict' OR merchant_status = 'conflict' THEN 'rule-conflict' WHEN n_merchants > 1 THEN 'merchant-collision'
  WHEN category_value IS NOT NULL AND category_id IS NOT NULL AND category_value <> category_id AND NOT locked THEN 'rule-changed' WHEN review_state = 'needsReview' AND NOT locked THEN 'low-confidence' WHEN category_id IS NULL AND NOT locked THEN 'unclassified' END AS reason,
  category_value AS suggested_category, merchant_value AS suggested_merchant FROM (SELECT * REPLACE (CASE WHEN txn_id % 8 = 0 THEN 'locked' ELSE category_status END AS category_status, CASE WHEN txn_id % 8 <> 0 THEN category_value END AS category_value), txn_id % 8 = 0 AS locked FROM results) LEFT JOIN firsts USING (description))"""


def _queue(spark, sf_dir) -> DataFrame:
    rows = L.ledger(spark, sf_dir).withColumn("category_locked", F.col("txn_id") % 8 == 0)
    return rules.review_queue(rows, L.RULES, merchants.first_merchant(merchants.alias_matches(rows, L.aliases(spark))))


@register(f"{_QUEUE} SELECT * FROM queue WHERE reason IS NOT NULL")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir)


@register(f"{_QUEUE}, w AS (SELECT unnest(['rule-conflict', 'merchant-collision', 'rule-changed', 'low-confidence', 'unclassified']) AS reason) SELECT w.reason, CAST(count(queue.reason) AS BIGINT) AS n FROM w LEFT JOIN queue USING (reason) GROUP BY w.reason")
def review_counts(spark, sf_dir):
    return rules.review_counts(_queue(spark, sf_dir))


@register(
    f"""{_RULES.replace('WITH ', f'WITH {L.ALIASES}, ', 1)}, {_MATCH} SELECT txn_id, coalesce(CASE WHEN n_merchants = 1 THEN matched_id END, m.value) AS merchant_id, category_value AS category_id,
  CASE WHEN category_status = 'conflict' OR (NOT coalesce(n_merchants = 1, FALSE) AND coalesce(m.status, '') = 'conflict') OR coalesce(n_merchants, 0) > 1 THEN 'needsReview' ELSE 'unreviewed' END AS review_state FROM results LEFT JOIN firsts USING (description) LEFT JOIN mer_result m USING (txn_id)"""
)
def import_classification(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).drop("category_id", "review_state")
    first = merchants.first_merchant(merchants.alias_matches(rows, L.aliases(spark)))
    return rules.classify_import(rows.withColumn("category_id", F.lit(None).cast("string")), L.RULES, first)


# Knowledge, backups, journals

_PARTS = "WITH mine AS (SELECT p_partkey AS id, p_name AS name, p_brand AS kind, p_size AS size FROM part WHERE p_partkey % 10 <> 0), theirs AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END AS kind, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part)"


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = L.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_size").alias("size"))
    theirs = p.withColumns({"kind": F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("kind")), "size": F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))})
    return p.filter("id % 10 <> 0"), theirs


@register(f"{_PARTS} SELECT t.id, CASE WHEN m.id IS NULL THEN 'add' WHEN m.name = t.name AND m.kind = t.kind AND m.size = t.size THEN 'unchanged' WHEN m.kind <> t.kind THEN 'conflict' ELSE 'update' END AS change FROM theirs t LEFT JOIN mine m USING (id)")
def brain_merge_diff(spark, sf_dir):
    return knowledge.merge_plan(*_parts(spark, sf_dir), guarded=("kind",))


@register(f"{_PARTS} SELECT t.id AS incoming_id, min(m.id) AS local_id FROM theirs t JOIN mine m ON lower(m.name) = lower(t.name) AND m.kind = t.kind WHERE t.id NOT IN (SELECT id FROM mine) GROUP BY t.id")
def semantic_duplicates(spark, sf_dir):
    mine, theirs = _parts(spark, sf_dir)
    return knowledge.semantic_duplicates(mine.withColumn("ordinal", F.col("id")), theirs, ("kind",))


@register(f"{_PARTS} SELECT t.id FROM theirs t JOIN mine m USING (id) WHERE m.kind <> t.kind OR m.size <> t.size")
def restore_conflicts(spark, sf_dir):
    return knowledge.restore_conflicts(*_parts(spark, sf_dir))


@register("SELECT 'customers' AS section, CAST(count(*) AS BIGINT) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def backup_manifest_counts(spark, sf_dir):
    t = lambda n: L.table(spark, sf_dir, n)
    return knowledge.manifest({"customers": t("customer"), "orders": t("orders"), "suppliers": t("supplier")}).select("section", "n_rows")


@register("SELECT user_id AS aggregate_id, max(ts) AS occurred_at, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def event_log_latest(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").select(F.col("user_id").alias("aggregate_id"), F.col("ts").alias("occurred_at"), "event_id")
    return knowledge.latest_events(e, e.filter("event_id % 3 = 0").select("event_id"))


@register("SELECT store, id FROM (SELECT event_type AS store, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 99")
def journal_retention(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").select(F.col("event_type").alias("store"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return knowledge.retained(e, 99).select("store", "id")


@register(f"WITH {L.LEDGER} SELECT txn_id, 'status' AS problem FROM (SELECT txn_id, CASE WHEN txn_id % 31 = 0 THEN 'lost' ELSE status END AS status FROM ledger) WHERE status = 'lost' UNION ALL SELECT txn_id, 'tags' FROM ledger WHERE txn_id % 37 = 0")
def transaction_validation(spark, sf_dir):
    rows = L.ledger(spark, sf_dir)
    broken = rows.withColumns({"status": F.when(F.col("txn_id") % 31 == 0, "lost").otherwise(F.col("status")), "tags": F.when(F.col("txn_id") % 37 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.col("tags"))})
    return knowledge.bad_transactions(broken)


@register("SELECT o_orderkey AS txn_id FROM orders WHERE o_custkey % 10 = 0")
def referential_integrity(spark, sf_dir):
    orders = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("account_id"))
    return knowledge.dangling(orders, "account_id", L.accounts(spark, sf_dir), "account_id").select("txn_id")


@register("SELECT event_type, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS p95, list_sort(list(value))[least(count(*), count(*) // 2 + 1)] AS median FROM events GROUP BY event_type")
def percentile_by_index(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").select("event_type", "value")
    p95 = knowledge.percentile_index(e, ["event_type"], "value", 0.95).withColumnRenamed("value", "p95")
    return p95.join(knowledge.percentile_index(e, ["event_type"], "value", 0.5).withColumnRenamed("value", "median"), "event_type")


@register(f"WITH {L.LEDGER}, n AS (SELECT CASE WHEN amount >= 0 THEN 'inflow' ELSE 'outflow' END AS direction, {_NORM} AS normalized, txn_id FROM ledger) SELECT direction, normalized, CAST(count(*) AS BIGINT) AS n, min(txn_id) AS first_id FROM n GROUP BY ALL")
def suggestion_batches(spark, sf_dir):
    return knowledge.suggestion_batches(rules.prepared(L.ledger(spark, sf_dir)))


# Dashboard

_MEMBERS = f"""{_PLAN}, wanted AS (SELECT s.name, s.currency FROM series s WHERE members % 2 = 0), rows_ AS (SELECT l.* FROM ledger l JOIN wanted w ON upper('plan ' || translate(CAST(account_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) = w.name AND l.currency = w.currency WHERE l.status = 'posted' AND amount < 0),
tagged AS (SELECT *, FALSE AS is_transfer, amount >= 0 AS is_inflow FROM rows_)"""


@register(f"{_MEMBERS} SELECT currency, {SUMS} FROM tagged GROUP BY currency")
def dashboard_recurring_status_filter(spark, sf_dir):
    """Cash flow of the members of confirmed series only, of every account."""
    return _confirmed_report(spark, _plans(L.ledger(spark, sf_dir)))


def _confirmed_report(spark, rows: DataFrame) -> DataFrame:
    found = recurring.proposals(rows)
    confirmed = found.filter("members % 2 = 0")
    ids = recurring.members(rows, confirmed).select("txn_id")
    kept = rows.join(ids, "txn_id", "left_semi")
    report = cashflow.by_currency(cashflow.tagged(kept, L.categories(spark), by_category=False))
    return report.select("currency", "income", "spending", "transfers", "net_cash_flow")


QUERIES["dashboard_recurring_whole_ledger"] = QUERIES["dashboard_recurring_status_filter"]


@register(f"{WITH} SELECT 'currencies' AS part, CAST(count(DISTINCT currency) AS BIGINT) AS n FROM tagged UNION ALL SELECT 'months', count(DISTINCT (currency, strftime(posted_date, '%Y-%m'))) FROM tagged WHERE status <> 'void' UNION ALL SELECT 'accounts', count(DISTINCT (currency, account_id)) FROM tagged WHERE status <> 'void' UNION ALL SELECT 'categories', count(DISTINCT (currency, coalesce(category_id, 'uncategorized'))) FROM tagged WHERE status <> 'void' AND NOT is_transfer AND NOT is_inflow")
def dashboard_bundle_counts(spark, sf_dir):
    from coinbrook.plans.cash_queries import tagged

    rows = tagged(spark, sf_dir)
    parts = {"currencies": cashflow.by_currency(rows), "months": cashflow.by_month(rows, L.AS_OF), "accounts": cashflow.by_account(rows), "categories": cashflow.spending_by_category(rows)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


