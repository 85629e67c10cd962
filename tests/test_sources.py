"""Statement readers on literal files."""

from datetime import date
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coinbrook.sources import csv_statement as csv
from coinbrook.sources import mapping, ofx_statement, pdf_items
from coinbrook.streaming import ingest, snapshots


def test_csv_rows_keep_their_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfDate,Description,Amount,Notes\n2026-06-01,"Coffee, ""dark""",-4.50,"two\nlines"\n2026-06-02,Pay,100\n\n2026-06-03,x,1,n,more\n')
    parsed = csv.read(spark, str(tmp_path / "a.csv"))
    rows = csv.rows(parsed).orderBy("row_number").collect()
    assert [r.source_location for r in rows] == ["lines:2-3", "line:4", "line:6"]
    assert rows[0].fields["Description"] == 'Coffee, "dark"' and rows[1].fields["Notes"] == "" and rows[2].fields["extra_1"] == "more"
    assert [r.code for r in csv.issues(parsed).collect()] == ["COLUMN_COUNT_MISMATCH"] * 2
    m = mapping.Mapping("acc", "CAD", "Date", "Description", amount="Amount")
    got = mapping.candidates(csv.rows(parsed), m).orderBy("posted_date").collect()
    assert [(r.posted_date, r.amount) for r in got] == [(date(2026, 6, 1), D("-4.50")), (date(2026, 6, 2), D("100.00")), (date(2026, 6, 3), D("1.00"))]
    assert mapping.accepted_exactly(mapping.candidates(csv.rows(parsed), m), csv.rows(parsed)).count() == 0


def test_csv_dialects():
    assert csv.detect_delimiter("Date;Description;Amount\n1;a,b;2\n") == ";" and csv.detect_delimiter("abc") == ","
    assert csv.header_names(["a", "", "a"]) == (["a", "column_2", "a_2"], True)
    assert csv.is_header(["Date", "Amount"]) and not csv.is_header(["1", "2"]) and not csv.is_header(["Date", "Date"])
    assert csv.is_header(["Merchant", "Value", "X"]) and not csv.is_header(["Ideal shop", "5.00", "x"])
    assert csv.parse(b"a,b", csv.Options(encoding="no-such"))[0][3][0] == "INVALID_ENCODING"
    assert csv.decode("é".encode("utf-16")) == "é" and csv.decode(b"\xe9", "cp1252") == "é"
    assert csv.parse(b"\xff\xff\xff")[0][3][0] == "INVALID_ENCODING" and csv.parse(b"")[0][3][0] == "EMPTY_FILE"
    rows = csv.parse(b"Date,Amount\n1,2\n3,4\nfoot,x\n", csv.Options(footer_rows=1))
    assert [r[0] for r in rows] == [1, 2, None] and rows[-1][3][0] == "FOOTER_DROPPED"
    with pytest.raises(ValueError):
        csv.Options(footer_rows=21)
    assert mapping.header_signature(["Date", "Amount"]) == mapping.header_signature([" date", "AMOUNT "]) != mapping.header_signature(["Date"])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_csv_never_fails(data):
    assert all(len(r) == 4 for r in csv.parse(data))


SGML = """OFXHEADER:100
DATA:OFXSGML
CHARSET:1252

<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><CURDEF>USD<BANKACCTFROM><BANKID>1<ACCTID>000123456<ACCTTYPE>CHECKING</BANKACCTFROM>
<BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260701120000[-5:EST]<TRNAMT>-42.509<FITID>F1<NAME>Caf\xe9 &amp; Co<MEMO>Lunch</STMTTRN>
<STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20260702<TRNAMT>1000,00<FITID>F2<NAME>Pay<MEMO>Pay</STMTTRN>
<STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20269902<TRNAMT>1<FITID>F3<NAME>Bad</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>882.50</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1></OFX>"""


def test_ofx(spark, tmp_path):
    (tmp_path / "a.ofx").write_bytes(SGML.encode("cp1252"))
    (tmp_path / "b.ofx").write_text('<?xml version="1.0"?><!DOCTYPE x><OFX></OFX>')
    raw = ofx_statement.read(spark, str(tmp_path))
    got = ofx_statement.transactions(raw).orderBy("source_id").collect()
    assert [(r.posted_date, r.amount, r.description) for r in got] == [(date(2026, 7, 1), D("-42.50"), "Café & Co — Lunch"), (date(2026, 7, 2), D("1000.00"), "Pay")]
    assert [r.code for r in ofx_statement.rejected(raw).collect()] == ["INVALID_POSTED_DATE"]
    account = ofx_statement.accounts(raw).first()
    assert (account.account_type, account.masked_number, account.ledger_balance) == ("checking", "••••3456", "882.50")
    assert raw.filter("problem is not null").count() == 1
    assert [ofx_statement.sniff(x, n) for x, n in ((SGML.encode(), ""), (b"%PDF-1", ""), (b"a,b", "x.qfx"), (b"a,b", "x"))] == ["ofx", "pdf", "ofx", "csv"]


ITEM = "doc string, page int, x double, y double, width double, text string"


def pdf_lines(spark, table):
    """Lines of (doc, page, [(x, text), ...]), top down."""
    return pdf_items.lines(spark.createDataFrame([(d, p, float(x), 800.0 - 20 * k, 5.0 * len(t), t) for k, (d, p, cells) in enumerate(table) for x, t in cells], ITEM))


def test_pdf_signed_amounts(spark):
    page = [
        ("d", 1, [(10, "My Bank"), (200, "CAD account")]),
        ("d", 1, [(10, "Date"), (80, "Description"), (300, "Amount")]),
        ("d", 1, [(10, "Opening balance"), (300, "10.00")]),
        ("d", 1, [(10, "2026-07-01"), (80, "TOTAL WINE & MORE"), (300, "-$1,004.50")]),
        ("d", 1, [(80, "downtown")]),
        ("d", 1, [(10, "7/2/26"), (80, "NEW BALANCE SHOES"), (300, "(99.00)")]),
        ("d", 2, [(80, "running")]),
        ("d", 2, [(10, "Date"), (80, "Description"), (300, "Amount")]),
        ("d", 2, [(80, "not a continuation")]),
        ("d", 2, [(10, "3 Jul 2026"), (80, "Pay"), (300, "100.00")]),
        ("d", 2, [(10, "Jul 4, 2026"), (80, "No amount"), (300, "soon")]),
        ("d", 2, [(10, "2026-02-30"), (80, "No such day"), (300, "1.00")]),
        ("other", 1, [(10, "no table here")]),
    ]
    lines = pdf_lines(spark, page)
    got = pdf_items.rows(lines).orderBy("row_number").collect()
    assert [(r.posted_date, r.description, r.amount, r.issue) for r in got] == [
        (date(2026, 7, 1), "TOTAL WINE & MORE downtown", D("-1004.50"), None),
        (date(2026, 7, 2), "NEW BALANCE SHOES running", D("-99.00"), None),
        (date(2026, 7, 3), "Pay", D("100.00"), None),
        (date(2026, 7, 4), "No amount", None, "MISSING_AMOUNT"),
    ]
    assert got[1].source_location == "page:1/line:6;page:2/line:1"
    found = {r.doc: r for r in pdf_items.detected(lines).collect()}
    assert (found["d"].mode, found["d"].currency, found["d"].supported) == ("signed-amount", "CAD", True) and 0.5 < found["d"].score <= 1
    assert found["other"].score == 0 and not found["other"].supported


def test_pdf_debit_and_credit(spark):
    page = [
        ("d", 1, [(10, "Date"), (80, "Details"), (300, "Paid out"), (400, "Paid in")]),
        ("d", 1, [(10, "2026-07-01"), (80, "Coffee"), (300, "4.50")]),
        ("d", 1, [(10, "2026-07-02"), (80, "Pay"), (400, "100.00")]),
        ("d", 1, [(10, "2026-07-03"), (80, "Both"), (300, "1.00"), (400, "2.00")]),
        ("d", 1, [(10, "2026-07-04"), (400, "2.00")]),
    ]
    got = pdf_items.rows(pdf_lines(spark, page)).orderBy("row_number").collect()
    assert [(r.amount, r.issue) for r in got] == [(D("-4.50"), None), (D("100.00"), None), (None, "AMBIGUOUS_AMOUNT"), (None, "MISSING_DESCRIPTION")]


def test_large_files_are_not_loaded(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("Date,Amount\n1,2\n")
    (tmp_path / "b.csv").write_text("Date,Amount\n" + "1,2\n" * 50)
    monkeypatch.setattr(csv, "MAX_BYTES", 30)
    monkeypatch.setattr(ofx_statement, "MAX_BYTES", 30)
    assert [(r.code, r.path[-5:]) for r in csv.issues(csv.read(spark, str(tmp_path))).collect()] == [("FILE_TOO_LARGE", "b.csv")]
    assert [r.path[-5:] for r in ofx_statement.read(spark, str(tmp_path)).collect() if r.problem and "more than" in r.problem] == ["b.csv"]


def test_stream_takes_files_once(spark, tmp_path):
    schema = "txn_id string, account_id string, posted_date date, amount decimal(18,2), currency string, description string, status string, review_state string, source_id string"
    row = lambda n, day: (f"t{n}", "a", date(2026, 7, day), D("-5.00"), "CAD", "Blue Bottle", "posted", "reviewed", None)
    source, target, at = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "cp")
    spark.createDataFrame([row(1, 1)], schema).write.parquet(source)
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(source), target, at).awaitTermination()
    run()
    assert ingest.revision(spark, target) == 1
    spark.createDataFrame([row(2, 2), row(1, 1)], schema).write.mode("append").parquet(source)
    run()
    got = {r.txn_id: r.review_state for r in ingest.load(spark, target).collect()}
    assert got == {"t1": "reviewed", "t2": "needsReview"}
    # A second stream begins at batch 0, on a ledger that has revisions already.
    other = str(tmp_path / "in2")
    spark.createDataFrame([row(3, 9)], schema).write.parquet(other)
    ingest.start(spark.readStream.schema(schema).parquet(other), target, str(tmp_path / "cp2")).awaitTermination()
    assert {r.txn_id for r in ingest.load(spark, target).collect()} == {"t1", "t2", "t3"}
    at_now = snapshots.newest(spark, target)
    assert at_now.number == 3 and sorted(at_now.taken.values()) == [0, 1]
    tables = snapshots.read(spark, target, at_now)
    assert sorted((r.n_rows, r.n_review) for r in tables["imports"].collect()) == [(1, 0), (1, 0), (1, 1)] and tables["fingerprints"].count() == 3


def test_ofx_encodings_at_the_edges():
    body = "<OFX>é</OFX>"
    sgml = lambda fields: f"OFXHEADER:100\r\n{fields}\r\n\r\n".encode()
    assert ofx_statement.decode(sgml("ENCODING:USASCII\r\nCHARSET:NONE") + body.encode("cp1252")).endswith(body)
    assert ofx_statement.decode(sgml("CHARSET:1252") + body.encode()).endswith(body)  # without ENCODING it is UTF-8 ...
    assert ofx_statement.decode(sgml("CHARSET:1252") + body.encode("cp1252")).endswith(body)  # ... unless it can't be
    assert ofx_statement.decode(b'<?xml version="1.0" encoding="latin1"?>\x80\x81') == '<?xml version="1.0" encoding="latin1"?>€\x81'
    assert ofx_statement.decode(b"") == ""
    for data, code in ((b"\xff\xfe\x00", "DECODE_FAILED"), (b"\xef\xbb\xbf" + sgml("ENCODING:LATIN1"), "UNSUPPORTED_ENCODING"), (sgml("") + b"\xff", "DECODE_FAILED"), (b"", "MALFORMED_DOCUMENT"), (b"<OFX></OFX>", "MALFORMED_DOCUMENT"), (b"<OFX>" + b"<A>" * 70, "ELEMENT_LIMIT_EXCEEDED")):
        with pytest.raises(ofx_statement.Refused, match=code):
            ofx_statement.statements(data)


def test_pdf_refusals_and_grid(spark, monkeypatch):
    monkeypatch.setattr(pdf_items, "MAX_ITEMS", 3)
    monkeypatch.setattr(pdf_items, "MAX_LENGTH", 100)
    row = lambda doc, page, text, x=1.0, n=1: [(doc, page, x, 1.0, 1.0, text)] * n
    rows = row("ok", 1, "a" * 24) + row("units", 1, "\U0001f600" * 12) + row("items", 1, "a" * 10, n=4) + row("long", 1, "a" * 60) + row("long", 2, "a" * 60) + row("image", 1, None, n=3) + row("huge", 1, "a" * 2001) + row("none", 1, "a" * 30) + row("pages", 1, "a" * 30) + row("unknown", 1, "a")
    items = spark.createDataFrame(rows, ITEM)
    documents = spark.createDataFrame([(d, 1) for d in ("ok", "units", "items", "long", "image", "huge", "empty")] + [("none", 0), ("null", None), ("pages", 101)], "doc string, n_pages int")
    got = {r.doc: r.code for r in pdf_items.refused(items, documents).collect()}
    assert got == {"items": "TEXT_LIMIT_EXCEEDED", "long": "TEXT_LIMIT_EXCEEDED", "image": "IMAGE_ONLY_DOCUMENT", "huge": "IMAGE_ONLY_DOCUMENT", "empty": "IMAGE_ONLY_DOCUMENT", "none": "MALFORMED_DOCUMENT", "null": "MALFORMED_DOCUMENT", "pages": "PAGE_LIMIT_EXCEEDED"}
    assert pdf_items.refused(items.limit(0), documents.limit(0)).count() == 0
    at = lambda x: row("d", 1, "t", x=x)
    placed = pdf_items.snapped(spark.createDataFrame(at(3.0) + at(-3.0) + at(4.99) + at(float("nan")) + at(float("-inf")) + at(None), ITEM))
    assert sorted(r.x for r in placed.collect()) == [-2.0, 0.0, 0.0, 0.0, 4.0, 4.0]


def test_layout_is_selected_by_margin(spark):
    seen = [("clear", 1, "a", 0.9, 0.5), ("clear", 2, "b", 0.8, 0.5), ("close", 1, "a", 0.9, 0.5), ("close", 2, "b", 0.81, 0.5), ("weak", 1, "a", 0.49, 0.5), ("alone", 1, "a", 0.5, 0.5), ("unlikely", 1, "a", 0.5, 0.5), ("unlikely", 2, "b", 0.45, 0.5), ("tie", 2, "b", 0.7, 0.5), ("tie", 1, "a", 0.7, 0.8)]
    detections = spark.createDataFrame(seen, "doc string, ordinal int, layout string, score double, minimum double")
    got = {r.doc: r.layout for r in pdf_items.selected(detections).collect()}
    assert got == {"clear": "a", "close": None, "weak": None, "alone": "a", "unlikely": "a", "tie": None}
    assert pdf_items.selected(detections.limit(0)).count() == 0
