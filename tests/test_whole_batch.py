"""Duplicates of every row of the ledger and of one batch with itself; ranks in groups."""

import random


from coinbrook.operators import duplicates, knowledge
from coinbrook.plans import registry
from tests.test_ledger import frame, txn


def test_every_row_is_matched_as_incoming(spark, sf):
    got = registry.queries()["duplicate_candidates"](spark, sf).collect()
    assert got and {r.incoming_id % 20 for r in got} > {0} and len({(r.existing_id, r.incoming_id) for r in got}) == len(got)


def test_candidates_equal_comparing_all_pairs(spark):
    """Pairs under several keys come once; days on both sides of a block's edge meet; a pair of null ids, days or amounts is none."""
    rng = random.Random(5)
    side = lambda first: [txn(first + n, rng.choice(["-5", "-6"]), f"2026-07-{rng.randint(1, 28):02}", description=rng.choice(["Blue Bottle Coffee", "BLUE bottle", "Tea"])) for n in range(60)]
    source = "CASE WHEN pmod(hash(txn_id), 3) = 0 THEN concat('s', pmod(hash(txn_id), 5)) END source_id"
    old, new = (frame(spark, *side(k)).selectExpr("*", source) for k in (1, 101))
    expected = set()
    keyed = [duplicates.with_keys(df).collect() for df in (old, new)]
    for a in keyed[0]:
        for b in keyed[1]:
            if a.account_id != b.account_id:
                continue
            words = 2 * len(set(a.words) & set(b.words)) / (len(a.words) + len(b.words))
            if a.source_id is not None and a.source_id == b.source_id or a.fingerprint == b.fingerprint:
                expected.add((a.txn_id, b.txn_id, "exact"))
            elif (a.currency, a.amount) == (b.currency, b.amount) and abs((a.posted_date - b.posted_date).days) <= 3 and words >= 0.5:
                expected.add((a.txn_id, b.txn_id, "likely"))
    got = [(r.existing_id, r.incoming_id, r.kind) for r in duplicates.candidates(old, new).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and {k for _, _, k in expected} == {"exact", "likely"}


def test_value_at_rank(spark):
    """A hot group, small ones, a null key, null values, ties; ranks at both ends."""
    rng = random.Random(7)
    rows = [("hot", rng.randint(0, 500)) for _ in range(3000)] + [("one", 4), ("ties", 1), ("ties", 1), (None, 3), (None, 9), ("nulls", None), ("some", None), ("some", 2), ("some", 8)]
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    df = spark.createDataFrame(rows, "k string, v int")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.value for r in knowledge.percentile_index(df, ["k"], "v", p).collect()}
        assert got == {k: sorted(vs, key=lambda v: (v is not None, v or 0))[min(len(vs) - 1, int(len(vs) * p))] for k, vs in groups.items()}


def test_within_batch(spark):
    rows = frame(spark, txn(1, "-5", description="Blue Bottle Coffee"), txn(2, "-5.00", "2026-07-02", description="BLUE bottle"), txn(3, "-6", description="Blue Bottle Coffee"), txn(4, "-5", "2026-07-20", description="Blue Bottle Coffee")).selectExpr("*", "cast(null as string) source_id")
    got = [(r.existing_id, r.incoming_id, r.kind) for r in duplicates.within_batch(rows).collect()]
    assert got == [("t1", "t2", "likely")]
