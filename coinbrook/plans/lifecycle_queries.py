"""Lifecycles, restores and acceptance over the tables, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.operators import entities, knowledge, lifecycles, recurring, rules
from coinbrook.plans import ledgers as L
from coinbrook.plans.match_queries import _SERIES
from coinbrook.plans.workspace_queries import fresh
from coinbrook.streaming import restores, snapshots
from coinbrook.streaming.snapshots import Change

QUERIES: dict = {}


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


# Logs: an aggregate a customer, an event an order, two in seven of them undos.

_ACTION = "CASE o_orderkey % 7 WHEN 0 THEN 'undo' WHEN 1 THEN 'undo' WHEN 2 THEN 'confirm' WHEN 3 THEN 'reject' WHEN 4 THEN 'edit' WHEN 5 THEN 'unlink' ELSE 'confirm' END"


@register(f"""WITH e AS (SELECT o_custkey AS aggregate_id, o_orderkey AS seq, {_ACTION} AS action FROM orders),
folded AS (SELECT aggregate_id, list_reduce(list_prepend([''], list([lpad(CAST(seq AS VARCHAR), 12, '0') || action] ORDER BY seq)), lambda a, x: CASE WHEN x[1] LIKE '%undo' THEN CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END ELSE list_concat(a, x) END) AS stack FROM e GROUP BY aggregate_id),
live AS (SELECT aggregate_id, list_transform(stack[2:], lambda x: substr(x, 13)) AS s FROM folded WHERE len(stack) > 1),
said AS (SELECT *, list_filter(s, lambda x: x <> 'edit') AS t FROM live)
SELECT aggregate_id, CASE t[len(t)] WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' WHEN 'unlink' THEN 'unlinked' END AS status, s[len(s)] AS last_action, CAST(len(s) AS BIGINT) AS n_standing FROM said""")
def decision_log_state(spark, sf_dir):
    events = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("aggregate_id"), F.col("o_orderkey").alias("seq"), F.expr(_ACTION).alias("action"))
    return lifecycles.state(events, lifecycles.LINK_STATUS)


# Merges, splits and reconciliation of the series of line items.

_DECIDED = f"""{_SERIES}, d AS (SELECT signature, name, CASE WHEN members % 3 = 0 THEN 'muted' ELSE 'confirmed' END AS status, cadence, CAST(members % 5 AS INTEGER) AS tolerance_days, CASE WHEN members % 4 = 0 THEN 'recurring-v0' ELSE 'recurring-v1' END AS detector_version, currency FROM series),
m AS (SELECT s.signature, e.name, e.posted_date, CAST(count(*) AS BIGINT) AS txn_id FROM series s JOIN e USING (name, currency) GROUP BY ALL)"""


def _decided(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each series as a decision; its members are named by their series and day (as line items have no key)."""
    rows = L.items(spark, sf_dir)
    found = lifecycles.cut(recurring.found(rows))
    n = F.col("members")
    decisions = found.select("signature", "name", F.when(n % 3 == 0, "muted").otherwise("confirmed").alias("status"), "cadence", (n % 5).cast("int").alias("tolerance_days"), F.when(n % 4 == 0, "recurring-v0").otherwise("recurring-v1").alias("detector_version"))
    members = recurring.eligible(rows).join(found.select("name", "currency", "signature"), ["name", "currency"]).select("signature", F.concat_ws("@", "name", F.col("posted_date").cast("string")).alias("txn_id")).distinct()
    return decisions, members


_KEYS = f"{_DECIDED}, k AS (SELECT signature, name || '@' || posted_date AS txn_id, name FROM m)"


@register(f"""{_KEYS}, w AS (SELECT left(name, 4) AS merge_id, signature FROM d), grp AS (SELECT merge_id, count(DISTINCT signature) AS n, 'merged:' || string_agg(signature, ':' ORDER BY signature) AS sig, arg_min(cadence, signature) AS cadence FROM w JOIN d USING (signature) GROUP BY merge_id),
own AS (SELECT signature, CAST(count(*) AS BIGINT) AS n_members FROM k GROUP BY signature), whole AS (SELECT merge_id, CAST(count(DISTINCT txn_id) AS BIGINT) AS n_members FROM k JOIN w USING (signature) GROUP BY merge_id)
SELECT sig AS signature, 'confirmed' AS status, cadence, n_members FROM grp JOIN whole USING (merge_id) WHERE n > 1
UNION ALL SELECT signature, CASE WHEN n > 1 THEN 'superseded' ELSE status END, d.cadence, n_members FROM d JOIN own USING (signature) JOIN grp ON merge_id = left(name, 4)""")
def recurring_merged(spark, sf_dir):
    """Series whose names begin alike are merged."""
    decisions, members = _decided(spark, sf_dir)
    wanted = decisions.select(F.substring("name", 1, 4).alias("merge_id"), F.substring("name", 1, 4).alias("name"), F.col("signature").alias("ordinal"), "signature")
    added, parts, _ = lifecycles.merges(decisions, wanted)
    n = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n_members"))
    sizes = n(members, "signature").unionByName(n(lifecycles.merged_members(members, parts), "key").join(added.select("key", "signature"), "key").drop("key"))
    return lifecycles.merged_decisions(decisions, added, parts).join(sizes, "signature").select("signature", "status", "cadence", "n_members")


@register(f"""{_KEYS}, grp AS (SELECT k.*, CASE WHEN length(d.name) % 3 = 2 THEN 1 ELSE CAST(right(txn_id, 1) AS INTEGER) % 2 + 1 END AS child, length(d.name) % 3 AS kind FROM k JOIN d USING (signature)),
n AS (SELECT signature, count(DISTINCT child) AS n, any_value(kind) AS kind FROM grp GROUP BY signature)
SELECT signature, CASE WHEN n > 1 AND kind = 0 THEN 'superseded' ELSE status END AS status, CASE WHEN n < 2 THEN 'fewer than two groups' WHEN kind = 1 THEN 'no partition of the members' END AS problem FROM d JOIN n USING (signature)
UNION ALL SELECT 'split:' || signature || ':' || child, 'confirmed', NULL FROM grp JOIN n USING (signature) WHERE n > 1 AND n.kind = 0 GROUP BY signature, child""")
def recurring_split(spark, sf_dir):
    """Series are split by the last digit of their days; one in three lists each member twice, one in three names one group."""
    decisions, members = _decided(spark, sf_dir)
    kind = F.length("name") % 3
    each = members.join(decisions.select("signature", "name"), "signature").withColumn("child", F.when(kind == 2, 1).otherwise(F.right("txn_id", F.lit(1)).cast("int") % 2 + 1))
    groups = each.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(kind == 1, 2).otherwise(1)))).drop("times")
    d, _, bad = lifecycles.split(decisions, members, groups)
    return d.join(bad, "signature", "left").select("signature", "status", "problem")


@register(f"""{_KEYS}, gone AS (SELECT DISTINCT signature FROM k WHERE right(txn_id, 2) = '13')
SELECT signature, CASE WHEN status = 'confirmed' AND (detector_version <> 'recurring-v1' OR signature IN (SELECT signature FROM gone)) THEN 'invalidated' ELSE status END AS status FROM d""")
def recurring_reconciled(spark, sf_dir):
    """What lies on the 13th of a month is not posted any more."""
    decisions, members = _decided(spark, sf_dir)
    ledger = members.select("txn_id").distinct().withColumn("status", F.when(F.right("txn_id", F.lit(2)) == "13", "void").otherwise("posted"))
    return lifecycles.reconciled(decisions, members, ledger).select("signature", "status")


@register(f"""{_KEYS}, gone AS (SELECT DISTINCT txn_id FROM k WHERE right(txn_id, 2) = '13'), l AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT 'void:recurring:' || signature AS event_id, 'recurring' AS aggregate_type, signature AS aggregate_id, 'invalidated' AS after FROM d WHERE status = 'confirmed' AND signature IN (SELECT signature FROM k JOIN gone USING (txn_id))
UNION ALL SELECT 'void:transfer:' || o_orderkey, 'transfer', CAST(o_orderkey AS VARCHAR), 'unlinked' FROM l WHERE o_orderkey % 3 <> 0 AND o_custkey % 7 = 0""")
def void_cascade_events(spark, sf_dir):
    """Links tie an order to its customer; the customers with a key divisible by seven, and members on the 13th, are voided."""
    decisions, members = _decided(spark, sf_dir)
    links = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("signature"), F.when(F.col("o_orderkey") % 3 == 0, "rejected").otherwise("confirmed").alias("status"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("outflow_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("inflow_id"))
    voided = members.filter(F.right("txn_id", F.lit(2)) == "13").select("txn_id").unionByName(L.table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("txn_id")))
    return lifecycles.void_events(voided, "void", links, decisions, members).select("event_id", "aggregate_type", "aggregate_id", "after")


# Confirmations of transfers: an order of a customer against another of the next customer, as commands in order of their keys.

_PAIRS = """p AS (SELECT o_orderkey AS seq, o_custkey AS a, (o_custkey + o_orderkey % 3) % (SELECT max(c_custkey) FROM customer) + 1 AS b FROM orders),
c AS (SELECT seq, a, b, a || '>' || b AS signature, CASE WHEN (a * 31 + b) % 11 = 0 THEN 'ambiguous' WHEN a % 13 = 0 OR b % 17 = 0 THEN 'stale' END AS early FROM p WHERE a <> b)"""


@register(f"""WITH {_PAIRS}, n AS (SELECT early, count(*) AS n FROM c GROUP BY early)
SELECT early AS refusal, CAST(n AS BIGINT) AS n FROM n WHERE early IS NOT NULL UNION ALL SELECT 'settled', CAST(count(*) AS BIGINT) FROM c WHERE early IS NULL""")
def transfer_confirmations(spark, sf_dir):
    """Refusals that need no order, and how many commands were settled one after another; tests/ hold each verdict against a plain loop."""
    return _judged(spark, sf_dir).groupBy(F.when(F.col("refusal").isNull() | (F.col("refusal") == "reused"), "settled").otherwise(F.col("refusal")).alias("refusal")).agg(F.count("*").alias("n"))


def _judged(spark, sf_dir) -> DataFrame:
    customers = L.table(spark, sf_dir, "customer")
    most = customers.agg(F.max("c_custkey").alias("most"))  # one row
    a, b = F.col("o_custkey"), (F.col("o_custkey") + F.col("o_orderkey") % 3) % F.col("most") + 1
    pairs = L.table(spark, sf_dir, "orders").join(F.broadcast(most)).select(F.col("o_orderkey").alias("seq"), a.alias("a"), b.alias("b")).filter("a <> b").withColumn("signature", F.concat_ws(">", F.col("a").cast("string"), F.col("b").cast("string")))
    day, one = F.lit("1998-01-01").cast("date"), F.lit(1).cast("decimal(18,2)")
    side = lambda n, k: (F.col(k).alias(f"{n}_id"), F.col(k).alias(f"{n}_account"), day.alias(f"{n}_date"), one.alias(f"{n}_amount"))
    proposals = pairs.dropDuplicates(["signature"]).select("signature", ((F.col("a") * 31 + F.col("b")) % 11 == 0).alias("is_ambiguous"), *side("outflow", "a"), *side("inflow", "b"))
    ledger = customers.select(F.col("c_custkey").alias("txn_id"), F.col("c_custkey").alias("account_id"), day.alias("posted_date"), one.alias("amount"))
    posted = ledger.withColumn("status", F.lit("posted"))
    stale = (F.col("outflow_id") % 13 == 0) | (F.col("inflow_id") % 17 == 0)
    proposals = proposals.withColumn("outflow_amount", F.when(stale, F.col("outflow_amount") + 1).otherwise(F.col("outflow_amount")).cast("decimal(18,2)"))
    links = spark.createDataFrame([], "signature string, status string, outflow_id long, inflow_id long")
    return lifecycles.judged_confirmations(pairs.select("seq", "signature"), proposals, posted, links)


# Restores of parts into a workspace that has other parts, and suggestions on orders.

_OWN = "own AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0), theirs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 1)"


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = L.table(spark, sf_dir, "part")
    named = lambda cond, name: p.filter(cond).select(F.col("p_partkey").alias("id"), name.alias("name"))
    return named("p_partkey % 3 <> 0", F.col("p_name")), named("p_partkey % 3 <> 1", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name")))


@register(f"""WITH {_OWN} SELECT 'merge' AS mode, id, name FROM own UNION ALL SELECT 'merge', id, name FROM theirs WHERE id NOT IN (SELECT id FROM own) UNION ALL SELECT 'new', id, name FROM theirs UNION ALL SELECT 'replace', id, name FROM theirs
UNION ALL SELECT 'conflict', id, NULL FROM own JOIN theirs USING (id) WHERE own.name <> theirs.name""")
def restores_in_all_modes(spark, sf_dir):
    own, theirs = _parts(spark, sf_dir)
    out = []
    for mode in restores.MODES:
        path = fresh(spark)
        at = snapshots.Snapshot() if mode == "new" else snapshots.commit(spark, path, snapshots.Snapshot(), {"parts": Change(own), "other": Change(own)})
        new = restores.restore(spark, path, at, {"parts": theirs}, {"parts": "id"}, mode, knowledge.manifest({"parts": theirs}))
        out.append(snapshots.table(spark, path, new, "parts").select(F.lit(mode).alias("mode"), "id", "name"))
    clash = restores.conflicts({"parts": own}, {"parts": theirs}, {"parts": "id"})
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(clash.select(F.lit("conflict").alias("mode"), F.col("key").cast("long").alias("id"), F.lit(None).cast("string").alias("name")))


@register("""SELECT o_orderkey AS suggestion_id, CASE WHEN o_orderkey % 5 = 0 THEN 'is rejected' WHEN o_orderkey % 7 = 0 THEN 'abstention' WHEN o_orderkey % 3 = 0 THEN 'changed' WHEN o_orderpriority = '5-LOW' OR o_custkey % 2 = 0 THEN 'resolved' END AS problem,
CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 7 = 0 THEN 'pending' WHEN o_orderkey % 3 = 0 OR o_orderpriority = '5-LOW' OR o_custkey % 2 = 0 THEN 'stale' ELSE 'accepted' END AS new_status FROM orders""")
def suggestions_accepted(spark, sf_dir):
    """A suggestion an order: some rejected before, some abstentions, some of rows that have changed, are locked or out of the queue."""
    o = L.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    suggestions = o.select(k.alias("suggestion_id"), F.when(k % 5 == 0, "rejected").otherwise("pending").alias("status"), F.when(k % 7 == 0, "abstain").otherwise("category").alias("kind"), k.alias("txn_id"), F.when(k % 3 == 0, k - 1).otherwise(k).alias("updated_at"), F.lit("food").alias("category_id"))
    ledger = o.select(k.alias("txn_id"), k.alias("updated_at"), (F.col("o_custkey") % 2 == 0).alias("category_locked"), F.lit(False).alias("merchant_locked"))
    queue = o.filter("o_orderpriority <> '5-LOW'").select(k.alias("txn_id"))
    return restores.judged_suggestions(o.select(k.alias("suggestion_id"), F.lit(None).cast("string").alias("merchant_id")), suggestions, ledger, queue).select("suggestion_id", "problem", "new_status")


# Commands and checks that had no query yet.


@register("""WITH r AS (SELECT * FROM (SELECT c_custkey, c_mktsegment || ' ' || c_nationkey AS cond, c_custkey % 3 AS priority, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) WHERE i <= 10000)
SELECT 'r' || a.c_custkey AS rule_a, 'r' || b.c_custkey AS rule_b, CASE WHEN a.priority > b.priority THEN 'shadowed' ELSE 'overlapping' END AS overlap FROM r a JOIN r b ON a.cond = b.cond AND a.c_custkey <> b.c_custkey""")
def rule_overlaps_of_table(spark, sf_dir):
    """Rules that ask for a customer's segment and nation; a rule table has 10,000 rows at most."""
    c = L.table(spark, sf_dir, "customer").orderBy("c_custkey").limit(rules.MAX_RULES)
    made = [rules.Rule(f"r{r.c_custkey}", "n", r.c_custkey % 3, (rules.Condition("normalizedDescription", "contains", f"{r.c_mktsegment} {r.c_nationkey}"),)) for r in c.select("c_custkey", "c_mktsegment", "c_nationkey").collect()]
    return rules.overlaps(spark, made)


@register("""WITH own AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)) SELECT 'transactions' AS section, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM own
UNION ALL SELECT 'fingerprints', count(*), sum(l_orderkey) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM own)""")
def backup_closure(spark, sf_dir):
    """The orders of the customers of every other nation, and what hangs on these."""
    accounts = L.table(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("account_id"))
    rows = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("account_id"))
    prints = L.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id")).distinct()
    count = lambda name, df: df.agg(F.count("*").alias("n"), F.sum("txn_id").alias("keys")).select(F.lit(name).alias("section"), "n", "keys")
    own, theirs = knowledge.closure(accounts, rows, prints)
    return count("transactions", own).unionByName(count("fingerprints", theirs))


@register("""WITH c AS (SELECT 'p' || p_partkey AS category_id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 4 THEN 'none' ELSE 'p' || (p_partkey - 1) END AS parent_id FROM part)
SELECT category_id, 'no such parent' AS problem FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT category_id FROM c) UNION ALL SELECT a.category_id, 'more than three levels' FROM c a JOIN c b ON a.parent_id = b.category_id JOIN c d ON b.parent_id = d.category_id WHERE d.parent_id IS NOT NULL""")
def category_hierarchy_problems(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    parents = F.when(k % 5 == 0, None).when(k % 5 == 4, "none").otherwise(name(k - 1))
    return knowledge.category_problems(L.table(spark, sf_dir, "part").select(name(k).alias("category_id"), parents.alias("parent_id")))


@register("""WITH old AS (SELECT DISTINCT 'm' || c_nationkey AS merchant_id, lower(c_mktsegment) AS pattern FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT DISTINCT 'm' || c_nationkey AS merchant_id, lower(c_mktsegment) AS pattern FROM customer)
SELECT merchant_id, pattern FROM old UNION SELECT merchant_id, pattern FROM new""")
def aliases_added(spark, sf_dir):
    """Aliases of half of the customers, and those that all of them add."""
    c = L.table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("merchant_id"), F.lower("c_mktsegment").alias("pattern"), F.lit("exact").alias("match_mode"), "c_custkey")
    return entities.add_aliases(c.filter("c_custkey % 2 = 0").drop("c_custkey").distinct(), c.drop("c_custkey")).select("merchant_id", "pattern")


@register("""WITH m AS (SELECT 'm' || c_custkey AS merchant_id FROM customer), a AS (SELECT DISTINCT 'm' || c_custkey % 50 AS merchant_id, lower(c_mktsegment) AS pattern FROM customer)
SELECT merchant_id, merchant_id = 'm1' AS archived, CASE WHEN merchant_id = 'm1' THEN 'm2' END AS redirect_to, CAST(coalesce(n, 0) AS BIGINT) AS n_aliases FROM m LEFT JOIN (SELECT CASE WHEN merchant_id = 'm2' THEN 'm2' ELSE merchant_id END AS merchant_id, count(DISTINCT pattern) AS n FROM (SELECT * FROM a UNION ALL SELECT 'm2', pattern FROM a WHERE merchant_id = 'm1') GROUP BY 1) USING (merchant_id)""")
def merchants_merged(spark, sf_dir):
    """The first customer's merchant is merged into the second's."""
    c = L.table(spark, sf_dir, "customer")
    name = lambda k: F.concat(F.lit("m"), k.cast("string"))
    merchants = c.select(name(F.col("c_custkey")).alias("merchant_id"), F.lit(False).alias("archived"), F.lit(None).cast("string").alias("redirect_to"))
    aliases = c.select(name(F.col("c_custkey") % 50).alias("merchant_id"), F.lower("c_mktsegment").alias("pattern"), F.lit("exact").alias("match_mode")).distinct()
    m, a = entities.merge_merchants(merchants, aliases, "m1", "m2")
    return m.join(a.groupBy("merchant_id").agg(F.count("*").alias("n")), "merchant_id", "left").select("merchant_id", "archived", "redirect_to", F.coalesce("n", F.lit(0)).alias("n_aliases"))


@register("""SELECT CAST(count(*) FILTER (p_partkey % 4 = 1 AND p_partkey % 3 <> 0) AS BIGINT) AS open_conflicts, CAST(count(*) FILTER (p_partkey % 4 = 2 AND p_partkey % 5 <> 0) AS BIGINT) AS open_duplicates, count(*) FILTER (p_partkey % 4 = 1 AND p_partkey % 3 <> 0) = 0 AND count(*) FILTER (p_partkey % 4 = 2 AND p_partkey % 5 <> 0) = 0 AS ok FROM part""")
def brain_apply_gate(spark, sf_dir):
    """A plan with a row a part: conflicts of which one in three is resolved, duplicates of which one in five is acknowledged."""
    p = L.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    plan = p.select("id", F.when(F.col("id") % 4 == 1, "conflict").otherwise("update").alias("change"))
    doubled = p.filter("id % 4 = 2").select(F.col("id").alias("incoming_id"))
    return knowledge.can_apply(plan, doubled, p.filter("id % 3 = 0"), p.filter("id % 5 = 0").select(F.col("id").alias("incoming_id")))


@register("SELECT o_orderpriority AS profile, o_orderstatus AS workload, 'c' || o_custkey % 40 AS metric, CAST(arg_max(o_totalprice, o_orderkey) AS DOUBLE) AS after FROM orders GROUP BY ALL HAVING CAST(arg_max(o_totalprice, o_orderkey) AS DOUBLE) > 1.2 * CAST(arg_min(o_totalprice, o_orderkey) AS DOUBLE)")
def performance_regressions(spark, sf_dir):
    """The price of a group's first order as the baseline, that of its last as what is compared."""
    key = ["profile", "workload", "metric"]
    o = L.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("workload"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("metric")).agg(F.min_by("o_totalprice", "o_orderkey").cast("double").alias("old"), F.max_by("o_totalprice", "o_orderkey").cast("double").alias("new"))
    return knowledge.performance_regressions(o.select(*key, F.col("old").alias("median")), o.select(*key, F.col("new").alias("median"))).select(*key, "after")


@register("SELECT section FROM (SELECT 'orders' AS section UNION ALL SELECT 'gone' UNION ALL SELECT 'new')")
def manifest_differences(spark, sf_dir):
    """Of all orders but one as a section, of customers unchanged, and of sections that one side lacks."""
    o, c = (L.table(spark, sf_dir, t) for t in ("orders", "customer"))
    before = knowledge.manifest({"orders": o, "customers": c, "gone": c})
    last = o.agg(F.max("o_orderkey").alias("o_orderkey"))
    return knowledge.verify_manifest(before, {"orders": o.join(last, "o_orderkey", "left_anti").select(*o.columns), "customers": c, "new": c})


@register(f"{_KEYS}, parts AS (SELECT txn_id, count(*) AS n FROM k GROUP BY txn_id) SELECT max(n) = 1 AS exact FROM parts")
def members_are_partition(spark, sf_dir):
    """Whether the members of all series are in one series each."""
    _, members = _decided(spark, sf_dir)
    return recurring.is_partition(members.select("txn_id"), members.select(F.col("signature").alias("part"), "txn_id"))
