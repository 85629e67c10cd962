"""The inverted rule index against rules compiled one by one."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from coinbrook.operators import rule_index, rules
from coinbrook.operators.rules import Condition, Rule

LEDGER = "txn_id long, description string, amount decimal(18,2), merchant_id string, account_id string, account_type string, category_id string, posted_date date, tags array<string>"


def generated(seed):
    rnd = random.Random(seed)
    words = ["coffee", "corner", "shop", "a", "market", "été", "go", "rent", ""]
    text = lambda n: " ".join(rnd.choices(words, k=rnd.randrange(1, n)))
    row = lambda i: (i, rnd.choice([text(5), None, "", text(3)]), rnd.choice([None, D(0), D(rnd.randrange(-99999, 99999)) / 100]), rnd.choice([None, "m1", "m2"]), rnd.choice(["1", "2", None]), rnd.choice(["checking", "savings"]), rnd.choice([None, "food", "rent"]), date(2026, 1, 1) + timedelta(rnd.randrange(9)), rnd.choice([None, [], ["home"], ["home", "work trip"], ["x"]]))

    def condition():
        kind = rnd.choice(rule_index.RARITY)
        field, operator = kind.split()
        if operator == "inRange":
            a, b = sorted(rnd.choice([rnd.randrange(0, 99999), rnd.randrange(0, 500)]) for _ in "ab")
            return Condition(field, operator, minimum=str(D(a) / 100), maximum=rnd.choice([str(D(b) / 100), str(D(b)), "99999999999999999999"]))
        value = {"amount": "12.5", "direction": rnd.choice(["inflow", "outflow"]), "merchantId": "m1", "accountId": "2", "accountType": "savings", "categoryId": "food", "postedDate": "2026-01-03", "tag": rnd.choice(["home", "x", "ork", "o"])}.get(field)
        return Condition(field, operator, value or rnd.choice(["coffee", "co", "corner shop", "o", "rket", "r s", "a", "coffee coffee corner"]))

    rule = lambda i: Rule(f"r{i}", "n", rnd.randrange(3), tuple(condition() for _ in range(rnd.choice([1, 1, 2, 3]))), *rnd.choice([("m", None), (None, "c"), ("m", f"c{i}")]), enabled=rnd.random() > 0.1)
    made = []
    while len(made) < 120:
        try:
            made.append(rule(len(made)))
        except ValueError:  # asks for both directions
            continue
    return [row(i) for i in range(250)], made


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_compiled_rules(spark, seed):
    rows, made = generated(seed)
    ledger = rules.prepared(spark.createDataFrame(rows, LEDGER)).withColumn("account_type", F.when(F.col("txn_id") % 2 == 0, "savings").otherwise("checking")).cache()
    want = {r.txn_id: r.hits for r in rules.matched(ledger, made).collect()}
    got = {r.txn_id: r.hits for r in rule_index.matched(ledger, rule_index.table_of(spark, made)).collect()}
    assert got == want and sum(map(len, got.values())) > 500
    by_kind = rule_index.matched(ledger, rule_index.table_of(spark, made), counted=False)
    assert {r.txn_id: r.hits for r in by_kind.collect()} == want
    both = [rules.results(f(ledger, x), F.col("merchant_id").isNotNull(), F.lit(False)).select("txn_id", "merchant_result", "category_result") for f, x in ((rules.matched, made[:30]), (rule_index.matched, rule_index.table_of(spark, made[:30])))]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))


def test_plan_does_not_grow_with_rules(spark):
    ledger = rules.prepared(spark.createDataFrame(generated(1)[0], LEDGER))
    many = lambda n: rule_index.table_of(spark, [Rule(f"r{i}", "n", 0, (Condition("normalizedDescription", "startsWith", f"shop {i:05d}"),), set_category="x") for i in range(n)])
    size = lambda n: len(rule_index.matched(ledger, many(n))._jdf.queryExecution().optimizedPlan().toString().replace(" ", ""))
    assert size(2000) < 1.1 * size(10)


def test_limits_and_no_rules(spark):
    ledger = rules.prepared(spark.createDataFrame(generated(1)[0], LEDGER))
    assert {len(r.hits) for r in rule_index.matched(ledger, rule_index.table_of(spark, [])).collect()} == {0}
    one = lambda conditions: spark.createDataFrame([(0, "r", 0, conditions, None, "c", True)], rule_index.RULES)
    for bad in ([], [("tag", "equals", "x" * 241, None, None)], [("tag", "equals", "x", None, None)] * 21):
        with pytest.raises(ValueError):
            rule_index.checked(one(bad))
    many = spark.range(rules.MAX_RULES + 1).select(F.col("id").cast("int").alias("ordinal"), F.lit("r").alias("rule_id"), F.lit(0).alias("priority"), F.array(F.struct(*[F.lit("x").alias(c) for c in ("field", "operator", "value", "minimum", "maximum")])).alias("conditions"), F.lit("m").alias("set_merchant"), F.lit("c").alias("set_category"), F.lit(True).alias("enabled"))
    with pytest.raises(ValueError):
        rule_index.checked(many)
