"""Queries over the whole ledger against Python's own grouping of it."""

from collections import defaultdict
from decimal import Decimal as D

from coinbrook.operators.recurring import CADENCES
from coinbrook.plans import ledgers as L
from coinbrook.plans import registry


def brute_series(spark, sf):
    """(account, currency): members, last day, upper median and ids of each series of the ledger."""
    groups = defaultdict(list)
    for r in L.ledger(spark, sf).filter("status = 'posted' and amount < 0").collect():
        groups[r.account_id, r.currency].append(r)
    out = {}
    for key, rows in groups.items():
        days = sorted(r.posted_date for r in rows)
        span, gaps = (days[-1] - days[0]).days, len(days) - 1
        if gaps >= 2 and any(low * gaps <= span <= high * gaps for _, low, high, _ in CADENCES):
            out[key] = (len(rows), days[-1], sorted(-r.amount for r in rows)[len(rows) // 2], rows)
    return out


def test_recurring_series_of_every_account(spark, sf):
    expected = brute_series(spark, sf)
    assert len({account % 10 for account, _ in expected}) > 3
    got = registry.queries()["recurring_incremental_whole_ledger"](spark, sf).collect()
    number = lambda s: int(s.split(":")[0].removeprefix("plan ").translate(str.maketrans("abcdefghij", "0123456789")))
    assert sorted((number(r.signature), r.signature.split(":")[2], r.members, r.last_seen, r.median) for r in got) == sorted((*k, n, day, median) for k, (n, day, median, _) in expected.items())


def test_dashboard_of_every_account(spark, sf):
    spending = defaultdict(D)
    for (_, currency), (n, _, _, rows) in brute_series(spark, sf).items():
        if n % 2 == 0:
            spending[currency] -= sum(r.amount for r in rows)
    got = registry.queries()["dashboard_recurring_whole_ledger"](spark, sf).collect()
    assert {r.currency: r.spending + r.transfers for r in got} == dict(spending)
