"""What statement readers refuse, warn of and decide, over files and documents made from the tables, with SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.plans import ledgers as L
from coinbrook.plans.statement_queries import _csv_files, _pdf_lines
from coinbrook.sources import csv_statement, ofx_statement, pdf_items

QUERIES: dict = {}


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


def _each(spark, sf_dir, content: str, path: str = "CAST(o_orderkey AS STRING)") -> DataFrame:
    """A file for each order."""
    return L.table(spark, sf_dir, "orders").select(F.expr(path).alias("path"), F.expr(content).alias("content"))


# OFX: encodings, sections and periods.

_BODY = "<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><CURDEF>EUR<BANKTRANLIST><DTSTART>', date_format(o_orderdate, 'yyyyMM'), '01<DTEND>', date_format(o_orderdate, 'yyyyMMdd'), '<STMTTRN><DTPOSTED>', date_format(o_orderdate, 'yyyyMMdd'), '<TRNAMT>1.00<NAME>Café ', o_orderkey, '</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>1<DTASOF>', CASE WHEN o_orderkey % 4 = 0 THEN '20260230' ELSE '20260228' END, '</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1>"


def _ofx(head: str, charset: str, mark: str = "") -> str:
    return f"concat(unhex('{mark}'), encode(concat('{head}', '{_BODY}</OFX>'), '{charset}'))"


_SGML = "OFXHEADER:100\nDATA:OFXSGML\n"
_XML = '<?xml version="1.0" encoding="{}"?>'
#: The start of a file, the encoding of its bytes, its mark, and what becomes of it.
_ENCODED = (
    (f"{_SGML}ENCODING:USASCII\nCHARSET:1252\n\n", "ISO-8859-1", "", None),
    (f"{_SGML}ENCODING:UTF-8\nCHARSET:NONE\n\n", "UTF-8", "EFBBBF", None),
    (f"{_SGML}ENCODING:USASCII\nCHARSET:1252\n\n", "UTF-8", "EFBBBF", "UNSUPPORTED_ENCODING"),
    (f"{_SGML}ENCODING:KOI8-R\n\n", "UTF-8", "", "UNSUPPORTED_ENCODING"),
    (f"{_SGML}ENCODING:USASCII\nCHARSET:850\n\n", "UTF-8", "", "UNSUPPORTED_ENCODING"),
    (_XML.format("UTF-16"), "UTF-16LE", "FFFE", None),
    (_XML.format("utf-16"), "UTF-16BE", "FEFF", None),
    (_XML.format("UTF-8"), "UTF-16LE", "FFFE", "UNSUPPORTED_ENCODING"),
    (_XML.format("Shift_JIS"), "UTF-8", "", "UNSUPPORTED_ENCODING"),
    (_XML.format("UTF-8"), "ISO-8859-1", "", "DECODE_FAILED"),
    (_XML.format("ISO-8859-1"), "ISO-8859-1", "", None),
)
_GOOD = ", ".join(str(n) for n, e in enumerate(_ENCODED) if e[3] is None)


def _encoded(spark, sf_dir) -> DataFrame:
    cases = " ".join(f"WHEN {n} THEN {_ofx(*e[:3])}" for n, e in enumerate(_ENCODED))
    return ofx_statement.parsed(_each(spark, sf_dir, f"CASE o_orderkey % {len(_ENCODED)} {cases} END"))


@register(f"SELECT CAST(o_orderkey AS VARCHAR) AS path, 'Café ' || o_orderkey AS description FROM orders WHERE o_orderkey % {len(_ENCODED)} IN ({_GOOD})")
def ofx_encodings(spark, sf_dir):
    """Eleven ways to declare, mark and write an encoding, of which five agree."""
    return ofx_statement.transactions(_encoded(spark, sf_dir)).select("path", "description")


@register(
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % {} {} END AS code, 'error' AS severity FROM orders WHERE o_orderkey % {} NOT IN ({})".format(
        len(_ENCODED), " ".join(f"WHEN {n} THEN '{e[3]}'" for n, e in enumerate(_ENCODED) if e[3]), len(_ENCODED), _GOOD
    )
)
def ofx_encodings_refused(spark, sf_dir):
    return ofx_statement.issues(_encoded(spark, sf_dir)).drop("source_location")


_SECTION = "CASE o_orderkey % 4 WHEN 0 THEN 'INVSTMTMSGSRSV1' WHEN 1 THEN 'LOANMSGSRSV1' WHEN 2 THEN 'EMAILMSGSRSV1' ELSE 'OTHERMSGSRSV1' END"


@register(f"""SELECT CAST(o_orderkey AS VARCHAR) AS path, 'section:' || {_SECTION} AS source_location, 'UNSUPPORTED_SECTION' AS code, 'warning' AS severity FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 5 > 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'section:SIGNONMSGSRSV1', 'UNSUPPORTED_SECTION', 'warning' FROM orders WHERE o_orderkey % 5 > 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'MALFORMED_DOCUMENT', 'error' FROM orders WHERE o_orderkey % 5 = 0""")
def ofx_sections(spark, sf_dir):
    """A sign-on and another section in each file; one file in five has no statement and is refused."""
    content = f"encode(concat('{_SGML}\n<OFX><SIGNONMSGSRSV1><SONRS><DTSERVER>20260101</SONRS></SIGNONMSGSRSV1><', {_SECTION}, '><X>1</', {_SECTION}, '>', CASE WHEN o_orderkey % 5 > 0 THEN concat('{_BODY.removeprefix('<OFX>')}') ELSE '' END, '</OFX>'), 'UTF-8')"
    return ofx_statement.issues(ofx_statement.parsed(_each(spark, sf_dir, content)))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS end_date, CASE WHEN o_orderkey % 4 > 0 THEN DATE '2026-02-28' END AS ledger_balance_date FROM orders")
def ofx_statement_periods(spark, sf_dir):
    """The period of each statement; one balance in four has no such day."""
    raw = ofx_statement.parsed(_each(spark, sf_dir, _ofx(*_ENCODED[1][:3])))
    return ofx_statement.accounts(raw).select("path", "start_date", "end_date", "ledger_balance_date")


_NAMED = "CASE o_orderkey % 7 WHEN 0 THEN '.qfx' WHEN 1 THEN '.PDF' ELSE '.csv' END"


@register(f"SELECT CAST(o_orderkey AS VARCHAR) || {_NAMED} AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'pdf' WHEN o_orderkey % 4 < 3 THEN 'ofx' WHEN o_orderkey % 7 = 0 THEN 'ofx' WHEN o_orderkey % 7 = 1 THEN 'pdf' ELSE 'csv' END AS format FROM orders")
def statement_formats(spark, sf_dir):
    """First bytes decide, then the name."""
    content = "encode(concat(CASE o_orderkey % 4 WHEN 0 THEN '\n%PDF-1.7 ' WHEN 1 THEN 'OFXHEADER:100\n' WHEN 2 THEN '<?xml?>\n<ofx>' ELSE 'Date,Amount\n' END, o_orderkey), 'UTF-8')"
    return ofx_statement.formats(_each(spark, sf_dir, content, f"concat(o_orderkey, {_NAMED})"))


# Delimited: encodings, footers and several files in one import.


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'Café ' || o_orderkey END AS description, CASE WHEN o_orderkey % 4 = 3 THEN 'INVALID_ENCODING' END AS code FROM orders")
def csv_encodings(spark, sf_dir):
    """UTF-8, the same with a mark, UTF-16 with a mark, and bytes that are not UTF-8."""
    one = lambda charset, mark: f"concat(unhex('{mark}'), encode(concat('Date,Description\n2026-01-01,Café ', o_orderkey, '\n'), '{charset}'))"
    content = f"CASE o_orderkey % 4 WHEN 0 THEN {one('UTF-8', '')} WHEN 1 THEN {one('UTF-8', 'EFBBBF')} WHEN 2 THEN {one('UTF-16LE', 'FFFE')} ELSE {one('ISO-8859-1', '')} END"
    return csv_statement.parsed(_each(spark, sf_dir, content)).select("path", F.col("fields")["Description"].alias("description"), "issue.code")


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(1 AS BIGINT) AS row_number, 'lines:2-3' AS source_location, CAST(NULL AS VARCHAR) AS code FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, 'FOOTER_DROPPED' FROM orders""")
def csv_footers(spark, sf_dir):
    """The last row of each file is a footer; what was wrong with it is no issue any more."""
    parsed = csv_statement.parsed(_csv_files(spark, sf_dir), csv_statement.Options(footer_rows=1))
    return parsed.select("path", "row_number", "source_location", "issue.code")


@register("""SELECT 'source:1/lines:2-3' AS source_location, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'source:1/line:4', CAST(count(*) AS BIGINT) FROM orders
UNION ALL SELECT 'source:2/lines:2-3', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'source:2/line:4', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0""")
def csv_sources_in_one_import(spark, sf_dir):
    """Every file, and a third of them as a second source."""
    files = _csv_files(spark, sf_dir)
    one, two = (csv_statement.rows(csv_statement.parsed(f)) for f in (files, files.filter("CAST(path AS BIGINT) % 3 = 0")))
    return csv_statement.numbered_sources(one, two).groupBy("source_location").agg(F.count("*").alias("n"))


# PDF: grid, refusals and the choice of a layout.

_X, _Y = "(c_acctbal / 7)", "(c_custkey % 1600 / 2.0)"


@register(f"SELECT CAST(c_custkey AS VARCHAR) AS doc, CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE floor(CAST({_X} AS DOUBLE) / 2 + 0.5) * 2 END AS x, floor(CAST({_Y} AS DOUBLE) / 2 + 0.5) * 2 AS y FROM customer WHERE c_custkey % 11 > 1")
def pdf_items_on_grid(spark, sf_dir):
    """Coordinates on the grid; one in thirteen is no number, one text in eleven is empty and one too long."""
    text = "CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN repeat('y', 2001) ELSE c_name END"
    items = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.expr(f"CASE WHEN c_custkey % 13 = 0 THEN double('NaN') ELSE CAST({_X} AS DOUBLE) END").alias("x"), F.expr(f"CAST({_Y} AS DOUBLE)").alias("y"), F.lit(5.0).alias("width"), F.expr(text).alias("text"))
    return pdf_items.snapped(items).select("doc", "x", "y")


_PAGES = "CASE WHEN o_custkey % 17 = 0 THEN 101 WHEN o_custkey % 17 = 1 THEN 0 ELSE 3 END"


@register(f"""WITH d AS (SELECT o_custkey, {_PAGES} AS n_pages, sum(CASE WHEN length(t) <= 2000 THEN length(t) ELSE 0 END) AS chars FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN repeat('z', 2001) ELSE o_orderpriority END AS t FROM orders) GROUP BY o_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS doc, CASE WHEN c_custkey % 17 = 1 THEN 'MALFORMED_DOCUMENT' WHEN c_custkey % 17 = 0 THEN 'PAGE_LIMIT_EXCEEDED' ELSE 'IMAGE_ONLY_DOCUMENT' END AS code FROM customer LEFT JOIN d ON o_custkey = c_custkey WHERE c_custkey % 17 < 2 OR coalesce(chars, 0) < 24""")
def pdf_documents_refused(spark, sf_dir):
    """A document a customer, an item an order; customers without orders are images."""
    items = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc"), (F.col("o_orderkey") % 3 + 1).alias("page"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN repeat('z', 2001) ELSE o_orderpriority END").alias("text"))
    documents = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.expr(_PAGES.replace("o_custkey", "c_custkey")).alias("n_pages"))
    return pdf_items.refused(items, documents)


@register("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(0.6 AS DOUBLE) AS generic, CASE c_custkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.55 WHEN 3 THEN 0.45 ELSE 0.7 END AS bank, c_custkey % 3 = 0 AS strict FROM customer)
SELECT doc, CASE WHEN bank = 0.9 THEN 'bank' WHEN bank = 0.45 OR strict AND bank < 0.65 THEN 'generic' WHEN bank = 0.7 THEN 'bank' END AS layout, greatest(generic, CAST(bank AS DOUBLE)) AS score,
CASE WHEN bank IN (0.9, 0.45, 0.7) OR strict AND bank < 0.65 THEN NULL ELSE 'several layouts are as likely' END AS problem FROM s""")
def pdf_layout_selected(spark, sf_dir):
    """The tabular layout, as detected in each document, against a second one whose scores are stated; one document in three asks more of the second."""
    found = pdf_items.detected(_pdf_lines(spark, sf_dir)).select("doc", "score")
    generic = found.select("doc", F.lit(1).alias("ordinal"), F.lit("generic").alias("layout"), "score", F.lit(0.5).alias("minimum"))
    stated = F.expr("CASE CAST(doc AS BIGINT) % 5 WHEN 0 THEN 0.9D WHEN 1 THEN 0.6D WHEN 2 THEN 0.55D WHEN 3 THEN 0.45D ELSE 0.7D END")
    bank = found.select("doc", F.lit(2).alias("ordinal"), F.lit("bank").alias("layout"), stated.alias("score"), F.expr("CASE WHEN CAST(doc AS BIGINT) % 3 = 0 THEN 0.65D ELSE 0.5D END").alias("minimum"))
    return pdf_items.selected(generic.unionByName(bank))
