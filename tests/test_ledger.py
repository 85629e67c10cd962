"""Literal vectors for the ledger's operators."""

from collections import Counter
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from coinbrook.functions import dates, money, text
from coinbrook.operators import cashflow, duplicates, knowledge, ledger, merchants, recurring, rules, transfers

SCHEMA = "txn_id string, account_id string, posted_date date, amount decimal(38,10), currency string, description string, status string, review_state string, merchant_id string, category_id string, tags array<string>, notes string"


def txn(n, amount, day="2026-07-01", **over):
    row = {"txn_id": f"t{n}", "account_id": "a1", "posted_date": date.fromisoformat(day), "amount": D(amount), "currency": "CAD", "description": f"Payment {n}", "status": "posted", "review_state": "reviewed", "merchant_id": None, "category_id": None, "tags": [], "notes": None}
    return tuple((row | over).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame([("g", "Groceries", "expense"), ("x", "Transfers", "transfer")], "category_id string, name string, kind string")


def test_cash_flow_totals(spark, categories):
    rows = frame(spark, txn(1, "1000.10"), txn(2, "-0.10", category_id="g"), txn(3, "-100", category_id="x"), txn(4, "100", category_id="x", account_id="a2"), txn(5, "0"))
    one = cashflow.by_currency(cashflow.tagged(rows, categories)).first()
    assert (one.income, one.spending, one.transfers, one.net_cash_flow) == (D("1000.10"), D("0.10"), D("200"), D("1000"))
    by = {r.account_id: r.transfers for r in cashflow.by_account(cashflow.tagged(rows, categories)).collect()}
    assert by == {"a1": D(100), "a2": D(100)}


def test_currency_of_voids_only_is_reported(spark, categories):
    rows = frame(spark, txn(1, "10", review_state="needsReview"), txn(2, "10", status="void"), txn(3, "5", currency="USD", status="void"))
    got = {r.currency: (r.income, r.n_unresolved, r.n_void) for r in cashflow.by_currency(cashflow.tagged(rows, categories)).collect()}
    assert got == {"CAD": (D(10), 1, 1), "USD": (D(0), 0, 1)}


def test_incomplete_months_and_filters(spark, categories):
    rows = frame(spark, txn(1, "1", "2026-06-20"), txn(2, "1", "2026-07-10"), txn(3, "1", "2026-05-01"))
    flt = ledger.CashFlowFilter(since=date(2026, 6, 15), until=date(2026, 7, 19))
    got = {r.month: r.incomplete for r in cashflow.by_month(cashflow.tagged(rows, categories, flt=flt), date(2026, 7, 19), flt).collect()}
    assert got == {"2026-06": True, "2026-07": True}
    with pytest.raises(ValueError, match="start date"):
        ledger.CashFlowFilter(since=date(2026, 7, 2), until=date(2026, 7, 1))
    assert ledger.apply_filter(rows, ledger.CashFlowFilter(account_ids=())).count() == 0
    assert flt.described() == "all transactions · 2026-06-15 to 2026-07-19 · all accounts · all currencies · all categories · all merchants · all tags · all review states · all recurring states"
    some = ledger.CashFlowFilter(account_ids=("a", "b"), currencies=("CAD", "USD"), tags=(), since=date(2026, 6, 15), review_states=("reviewed",))
    assert some.described(2, ("confirmed",)) == "2 selected transaction(s) · 2026-06-15 to Today · 2 account(s) · CAD, USD · all categories · all merchants · 0 tag(s) · reviewed · confirmed"


def test_savings_rate(spark):
    months = spark.createDataFrame([("2026-06", D(2500), D(1000), False), ("2026-07", D(2500), D(500), True), ("2026-08", D(0), D(-1), False), ("2026-09", D(3), D(1), False)], "month string, income decimal(38,2), net_cash_flow decimal(38,2), incomplete boolean")
    got = {r.month: (r.rate and str(r.rate), r.rate_status) for r in cashflow.savings_rate(months).collect()}
    assert got == {"2026-06": ("0.4000", "normal"), "2026-07": ("0.2000", "incomplete"), "2026-08": (None, "notApplicable"), "2026-09": ("0.3333", "normal")}


def test_money_text(spark):
    values = ["1000.1000000000", "45.0000000000", "0E-10", "-0.1000000000", "100"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(money.render(F.col("v").cast("decimal(38,10)"))).collect()] == ["1000.1", "45", "0", "-0.1", "100"]
    given = {"-$82.45": "-82.45", "(1,234.50)": "-1234.50", "EUR 5": "5.00", "5 usd": "5.00", "1,23": None, "12.345": None, "12.": "12.00", "(-5)": None, "+7.5": "7.50", "abc": None, "": None, "1,234,567": "1234567.00", "€3": "3.00"}
    df = spark.createDataFrame([(k,) for k in given], "v string")
    got = {r.v: r.p and str(r.p) for r in df.select("v", money.parse_locale_number(F.col("v")).alias("p")).collect()}
    assert got == given
    df = spark.createDataFrame([("1.234,5",), ("1 234.5",)], "v string")
    assert [r[0] for r in df.select(money.parse_locale_number(F.col("v"), ",", ".")).collect()] == [D("1234.50"), None]
    cents = spark.createDataFrame([(D(1), D(3))], "a decimal(38,2), b decimal(38,2)").select(money.ratio(F.col("a"), F.col("b"), 4), money.percentage(F.col("a"), F.col("b"))).first()
    assert [str(x) for x in cents] == ["0.3333", "33.3"]


def test_normalizers(spark):
    given = {"SQ *Café Nö 1234 #55": "caf n", "TST* Blue Bottle Store #45 12/31": "blue bottle", "PAYPAL *NETFLIX.COM 866X7 2024-01-02": "netflix com", "Ｎｅｔｆｌｉｘ": "netflix", "é1234": "", None: "", "   ": "", "pos LOC 12 abc": "abc"}
    df = spark.createDataFrame([(k,) for k in given], "d string")
    got = {r.d: r.n for r in df.select("d", text.normalize_merchant(F.col("d")).alias("n")).collect()}
    assert {k: v for k, v in got.items() if k != "é1234"} == {k: v for k, v in given.items() if k != "é1234"}
    one = spark.createDataFrame([("Netflix 12  x\t3",)], "d string").select(text.normalize_recurring(F.col("d")), text.normalize_duplicate(F.lit("Ａ-b! é_2")), text.normalize_import(F.lit(" a  b "))).first()
    assert list(one) == ["NETFLIX X", "a b é 2", "a b"]


def test_spreadsheet_cells(spark):
    bad = ["=1", "+1", "-1", "@x", "\tx", "\rx", " =1", "\n-1", "  +x", "=", "@", "-"]
    df = spark.createDataFrame([(x,) for x in [*bad, "ok", "a=1"]], "c string")
    assert [r[0] for r in df.select(text.spreadsheet_safe(F.col("c"))).collect()] == ["'" + x for x in bad] + ["ok", "a=1"]
    cells = df.limit(1).select(text.csv_cell(F.lit('a"b')), text.csv_cell(F.lit("a")), text.report_cell(F.lit("=a\x00")), text.rejected_summary(F.lit("abc 12345678901234567")), text.mask_account(F.lit("12-3456")), text.issue_code(F.lit("postedDate"))).first()
    assert list(cells) == ['"a""b"', "a", '"\'=a"', "••• ••••••••••••… (21 characters)", "••••3456", "INVALID_POSTED_DATE"]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("2024-2-9",)], "v string")
    assert [r[0] for r in df.select(dates.strict_date(F.col("v"), "YYYY-MM-DD")).collect()] == [None, date(2024, 2, 29), None]
    ofx = ["20260701", "20260701120000.000[-5:EST]", "20260230", "2026"]
    got = spark.createDataFrame([(x,) for x in ofx], "v string").select(dates.ofx_date(F.col("v"))).collect()
    assert [r[0] for r in got] == [date(2026, 7, 1), date(2026, 7, 1), None, None]


def test_ledger_pages_compare_exactly(spark):
    rows = frame(spark, txn(1, "9007199254740993.01"), txn(2, "9007199254740993.001", description="Smaller"), txn(3, "-1"))
    shown, total = ledger.page(rows, sort="amount", descending=False, offset=1, limit=1)
    assert shown.first().description == "Smaller" and total.first().total == 3
    with pytest.raises(ValueError):
        ledger.page(rows, limit=1001)


def test_tags_any_and_all(spark):
    rows = frame(spark, txn(1, "1", tags=["Home", "food"]), txn(2, "1", tags=["home"]), txn(3, "1"))
    ids = lambda c: sorted(r.txn_id for r in rows.filter(c.condition()).collect())
    assert ids(ledger.CashFlowFilter(tags=("home",))) == ["t2"]
    assert ids(ledger.LedgerFilter(tags=("HOME",))) == ["t1", "t2"] and ids(ledger.LedgerFilter(tags=("home", "Food"))) == ["t1"]
    assert ids(ledger.LedgerFilter(search="ＰＡＹＭＥＮＴ 2")) == ["t2"]


def test_bulk_edit(spark):
    rows = frame(spark, txn(1, "1"), txn(2, "1", category_id="g"))
    ids = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("zz",)], "txn_id string")
    one = ledger.bulk_edit_preview(rows, ids, ledger.Edit(category_id="g")).first()
    assert (one.selected, one.affected, one.unchanged, one.missing) == (3, 1, 1, 1)
    assert ledger.bulk_edit_preview(rows, ids, ledger.Edit(merchant_id="m")).first().affected == 0


def alias(merchant, ordinal, pattern, mode="tokenPrefix", archived=False, redirect=None):
    return (merchant, merchant.upper(), ordinal, f"{merchant}-{pattern}", 1, pattern, mode, archived, redirect)


ALIAS_SCHEMA = "merchant_id string, merchant_name string, ordinal int, alias_id string, alias_ordinal int, pattern string, match_mode string, archived boolean, redirect_to string"


def test_merchants(spark):
    a = spark.createDataFrame([alias("netflix", 2, "netflix"), alias("net", 1, "et", "contains"), alias("old", 0, "netflix", archived=True), alias("moved", 0, "netflix", redirect="net"), alias("exact", 3, "netflix com", "exact")], ALIAS_SCHEMA)
    rows = frame(spark, txn(1, "-16.99", "2026-06-15", description="NETFLIX.COM"), txn(2, "-16.99", "2026-07-15", description="Netflix 123"), txn(3, "-45.00", description="Corner shop"))
    found = merchants.alias_matches(rows, a)
    assert Counter((r.description, r.merchant_id) for r in found.collect()) == Counter([("NETFLIX.COM", m) for m in ("netflix", "net", "exact")] + [("Netflix 123", m) for m in ("netflix", "net")])
    only = a.filter("merchant_id = 'netflix'")
    got = merchants.ranked(merchants.ranking(merchants.monthly_trend(rows, only))).collect()
    assert [(r.matched_name, str(r.spending), r.n_transactions) for r in got] == [("Unresolved Merchants", "45.00", 1), ("NETFLIX", "33.98", 2)]


def test_redirect_cycles_end(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "x")], "merchant_id string, redirect_to string")
    assert {r.merchant_id: r.final_id for r in merchants.follow_redirects(m).collect()} == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "y", "z": "z"}


def test_recurring(spark):
    rows = frame(spark, *[txn(i, "-16.99", d, description=f"Netflix.com Toronto ON {i}") for i, d in enumerate(("2026-05-15", "2026-06-15", "2026-07-15"))], *[txn(10 + i, f"-{i + 1}", f"2026-01-{1 + 10 * i:02d}", description="Gap") for i in range(3)])
    one = recurring.proposals(rows).collect()
    assert len(one) == 1
    s = one[0]
    assert (s.signature, s.cadence, s.median, s.next_expected, s.confidence) == ("netflix.com toronto on:cad:CAD:monthly", "monthly", D("16.99"), date(2026, 8, 14), 0.95)
    four = frame(spark, *[txn(i, f"-{i}", f"2026-01-{1 + 7 * (i - 1):02d}", description="W") for i in (1, 2, 3, 4)])
    w = recurring.proposals(four).first()
    assert (w.cadence, w.median, w.is_variable) == ("weekly", D(3), True)
    decided = spark.createDataFrame([(s.signature, 1, "muted"), (s.signature, 2, "confirmed")], "signature string, ordinal int, status string")
    total = recurring.summary(recurring.proposals(rows), decided).first()
    assert (total.confirmed_spend, total.n_confirmed, total.n_proposed) == (D("16.99"), 1, 0)


def test_transfers(spark):
    rows = frame(spark, txn(1, "-500", "2026-07-20"), txn(2, "500", "2026-07-21", account_id="a2"), txn(3, "-500", "2026-07-25", account_id="a3"), txn(4, "500", "2026-07-21"))
    one = transfers.pairs(rows).collect()
    assert [(r.outflow_id, r.inflow_id, r.score, r.is_ambiguous, r.fee) for r in one] == [("t1", "t2", 11_700, False, None)]
    both = frame(spark, txn(1, "-100"), txn(2, "-100"), txn(3, "100", account_id="a2"), txn(4, "95", account_id="a4", currency="USD"))
    found = transfers.pairs(both)
    assert [r.is_ambiguous for r in found.collect()] == [True, True] and transfers.confirmable(found, found.limit(0).selectExpr("signature", "'x' status", "outflow_id", "inflow_id")).count() == 0
    assert [x.weight for x in transfers.evidence(found).first().evidence] == [3000, 2000, 5000, -1000]
    fee = transfers.pairs(frame(spark, txn(1, "-100"), txn(2, "92", account_id="a2"))).first()
    assert (fee.fee, fee.score) == (D(8), 9000)


def test_duplicates(spark):
    rows = lambda *r: frame(spark, *r).withColumn("source_id", F.when(F.col("notes") == "s", "S1"))
    old = rows(txn(1, "-5", description="Blue Bottle Coffee"), txn(2, "-6", notes="s"), txn(3, "-7", "2026-07-01"))
    new = rows(txn(11, "-5.00", "2026-07-02", description="BLUE bottle"), txn(12, "-9", notes="s"), txn(13, "-7", "2026-07-09", description="Payment 3"))
    got = {(r.existing_id, r.incoming_id): (r.kind, r.score) for r in duplicates.candidates(old, new).collect()}
    assert got == {("t1", "t11"): ("likely", 4000 + 2000 + 2800), ("t2", "t12"): ("exact", 10_000)}
    events = [("decision", "e1", "t2:t12", "keep-new", None), ("decision", "e2", "t1:t11", "keep-existing", None), ("undo", "u", None, None, "e2")]
    signed = duplicates.evidence_signature(duplicates.candidates(old, new)).select("candidate_id", "evidence_signature")
    log = spark.createDataFrame(events, "type string, event_id string, candidate_id string, action string, decision_id string").join(signed, "candidate_id", "left")
    after = {r.txn_id: r.status for r in duplicates.project(old, duplicates.candidates(old, new), log).collect()}
    assert after == {"t1": "posted", "t2": "void", "t3": "posted"}
    with pytest.raises(Exception, match="used twice"):
        duplicates.active_decisions(log.unionByName(log)).collect()


def test_rules(spark):
    c = rules.Condition
    some = [rules.Rule("r1", "a", 1, (c("normalizedDescription", "contains", "pay"),), set_category="x"), rules.Rule("r2", "b", 1, (c("normalizedDescription", "startsWith", "payment"),), set_category="y"), rules.Rule("r3", "c", 1, (c("amount", "inRange", minimum="0", maximum="10"),), set_category="z"), rules.Rule("r4", "d", 0, (c("direction", "equals", "inflow"),), set_merchant="m")]
    out = rules.results(rules.matched(rules.prepared(frame(spark, txn(1, "-50"), txn(2, "5"), txn(3, "0", description="other"))), some), F.lit(False), F.col("txn_id") == "t3")
    got = {r.txn_id: (r.category_result.status, r.category_result.value, tuple(r.category_result.matched), r.merchant_result.value) for r in out.collect()}
    assert got == {"t1": ("matched", "y", ("r1", "r2"), None), "t2": ("conflict", None, ("r2", "r3"), "m"), "t3": ("locked", None, (), "m")}
    with pytest.raises(TypeError):
        c("accountId", "contains", "x")
    with pytest.raises(ValueError):
        rules.Rule("r", "n", 0, (c("direction", "equals", "inflow"), c("direction", "equals", "outflow")))
    same = (c("accountId", "equals", "a"),)
    a, b = rules.Rule("a", "a", 1, same, set_category="p"), rules.Rule("b", "b", 1, same, set_category="q")
    assert rules.definite_conflicts([a, b]) == [("a", "b")] and rules.overlap(a, b) == "overlapping" and rules.overlap(a, a) == "identical"


def test_knowledge(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    whole = knowledge.manifest({"s": df}).collect()
    assert whole == knowledge.manifest({"s": df.orderBy(F.desc("id"))}).collect() and whole[0].n_rows == 2
    assert knowledge.verify_manifest(knowledge.manifest({"s": df}), {"s": df.filter("id = 1")}).count() == 1
    assert knowledge.verify_manifest(knowledge.manifest({"s": df}), {"s": df}).count() == 0
    plan = knowledge.merge_plan(df, df.filter("id = 1").unionByName(spark.createDataFrame([(3, "A")], df.schema)))
    dup = knowledge.semantic_duplicates(df.withColumn("ordinal", F.col("id")), spark.createDataFrame([(3, "A")], df.schema))
    assert dup.collect() == [(3, 1)]
    assert knowledge.can_apply(plan, dup).first().ok is False and knowledge.can_apply(plan, dup, acknowledged=dup).first().ok is True
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "zz")], "category_id string, parent_id string")
    assert {(r.category_id, r.problem[:2]) for r in knowledge.category_problems(tree).collect()} == {("d", "mo"), ("e", "no")}
    outcomes = spark.createDataFrame([("t", True, False, False, True), ("t", True, True, True, False), ("t", False, True, False, False)], "task string, valid boolean, abstained boolean, should_abstain boolean, correct boolean")
    m = knowledge.evaluation_metrics(outcomes).first()
    assert (m.accuracy, m.abstention_precision, m.abstention_recall) == (1.0, 0.5, 1.0)


def test_dashboard(spark, categories):
    from coinbrook.operators import dashboard as d

    rows = frame(spark, *[txn(i, "-16.99", f"2026-0{i}-15", description="Netflix") for i in (4, 5, 6)], txn(7, "100", "2026-06-01"), txn(8, "-50", "2026-06-02", description="Once"), txn(9, "-9", "2026-06-03"), txn(10, "9", "2026-06-03", account_id="a2"))
    links = spark.createDataFrame([("s", "t9", "t10", "confirmed")], "signature string, outflow_id string, inflow_id string, status string")
    decisions = spark.createDataFrame([("netflix:cad:CAD:monthly", 1, "confirmed")], "signature string, ordinal int, status string")
    a = spark.createDataFrame([alias("netflix", 1, "netflix")], ALIAS_SCHEMA)
    inputs = d.Inputs(rows, categories, a, links, decisions)
    out = d.dashboard(inputs, date(2026, 7, 1))
    one = out["cash_flow"].first()
    assert (one.income, one.spending, one.transfers) == (D(100), D("100.97"), D(18))
    assert out["recurring"].first().confirmed_spend == D("16.99")
    only = d.dashboard(inputs, date(2026, 7, 1), recurring_statuses=("confirmed",))
    assert only["cash_flow"].first().spending == D("50.97") and only["merchants"].count() == 1
    assert d.dashboard(inputs, date(2026, 7, 1), recurring_statuses=("muted",))["cash_flow"].count() == 0
    assert d.takeaways(out["cash_flow"]).first().takeaway == "Spending exceeds income by CAD 0.97."


def test_entities(spark):
    from coinbrook.operators import entities as e

    m = spark.createDataFrame([("a", False, None), ("b", False, None)], "merchant_id string, archived boolean, redirect_to string")
    al = spark.createDataFrame([("a", "x", "exact"), ("b", "x", "exact"), ("a", "y", "exact")], "merchant_id string, pattern string, match_mode string")
    m2, al2 = e.merge_merchants(m, al, "a", "b")
    assert {tuple(r) for r in m2.collect()} == {("a", True, "b"), ("b", False, None)} and al2.count() == 4
    assert {tuple(r) for r in e.unmerge_merchant(m2, "a").collect()} == {tuple(r) for r in m.collect()}
    assert e.seeded_categories(spark.createDataFrame([], "category_id string, name string, kind string, position int")).count() == 11
    t = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    change = spark.createDataFrame([(1, ("x",), ("z",))], "id long, before struct<v:string>, after struct<v:string>")
    done = e.apply_operation(t, change, "id")
    assert sorted(map(tuple, done.collect())) == [(1, "z"), (2, "y")] and sorted(map(tuple, e.undo_operation(done, change, "id").collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="changed meanwhile"):
        e.apply_operation(done, change, "id").collect()
    acc = spark.createDataFrame([("a1", "CAD"), ("a2", "CAD")], "account_id string, currency string")
    led = frame(spark, txn(1, "1"))
    assert [sorted(map(tuple, e.change_currency(acc, led, a, "USD").collect())) for a in ("a1", "a2")] == [[("a1", "CAD"), ("a2", "CAD")], [("a1", "CAD"), ("a2", "USD")]]
    row = spark.createDataFrame([("0e8dd1a2-1111-4abc-8abc-0123456789ab",), ("nope",)], "u string")
    assert [r[0] for r in row.select(e.is_uuid(F.col("u"))).collect()] == [True, False]


def test_files(spark, tmp_path):
    from coinbrook.sources import sinks

    df = spark.createDataFrame([(2, "b"), (1, "é")], "id long, name string")
    sinks.write_knowledge({"categories": df}, str(tmp_path / "k"))
    assert sorted(map(tuple, sinks.read_knowledge(spark, str(tmp_path / "k"), {"categories": "id long, name string"})["categories"].collect())) == [(1, "é"), (2, "b")]
    sinks.write_backup({"s": df}, str(tmp_path / "b"))
    assert sinks.read_backup(spark, str(tmp_path / "b"))["s"].count() == 2
    df.filter("id = 1").write.mode("overwrite").parquet(str(tmp_path / "b" / "s"))
    with pytest.raises(ValueError, match="differ"):
        sinks.read_backup(spark, str(tmp_path / "b"))
    sinks.write_error_report(spark.createDataFrame([("line:1", "INVALID_AMOUNT", "=x")], "source_location string, code string, rejected string"), str(tmp_path / "e"))
    lines = b"".join(p.read_bytes() for p in (tmp_path / "e").glob("part-*"))
    assert lines == b'"line:1","INVALID_AMOUNT","","","","\'=x",""\r\n'
    assert sinks.fingerprints(frame(spark, txn(1, "1.00"), txn(2, "1", description="Payment 1"))).select("fingerprint").distinct().count() == 1
