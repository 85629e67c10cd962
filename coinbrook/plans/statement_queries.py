"""Statement readers, reports and commands over the tables: orders and customers are written as statements and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import dates, text
from coinbrook.operators import cashflow, dashboard, duplicates, entities, knowledge, orders, transfers
from coinbrook.plans import cash_queries, match_queries
from coinbrook.plans import ledgers as L
from coinbrook.plans.text_queries import PLAIN, dice_sql, fingerprint_sql, tokens_sql
from coinbrook.sources import csv_statement, ofx_statement, pdf_items, sinks

QUERIES: dict = {}


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


# Delimited statements: one file an order, in four dialects, with quotes, a line break in a cell and a short row.

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"


def _csv_files(spark, sf_dir) -> DataFrame:
    d = "element_at(array(',', ';', '\t', '|'), CAST(o_orderkey % 4 AS INT) + 1)"
    content = f"concat('Date', {d}, 'Description', {d}, 'Amount', {d}, 'Notes\n', {_DAY}, {d}, '\"', o_orderpriority, ', \"\"q\"\" ', o_orderkey, '\"', {d}, {_MONEY}, {d}, '\"two\nlines\"\n', {_DAY}, {d}, 'plain\n')"
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.encode(F.expr(content), "UTF-8").alias("content"))


_CSV_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(1 AS BIGINT) AS row_number, 'lines:2-3' AS source_location, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted, o_orderpriority || ', "q" ' || o_orderkey AS description, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, 'two' || chr(10) || 'lines' AS notes FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'line:4', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'plain', '', '' FROM orders"""


@register(_CSV_SQL)
def csv_statement_rows(spark, sf_dir):
    rows = csv_statement.rows(csv_statement.parsed(_csv_files(spark, sf_dir)))
    return rows.select("path", "row_number", "source_location", *[F.col("fields")[k].alias(n) for k, n in (("Date", "posted"), ("Description", "description"), ("Amount", "amount"), ("Notes", "notes"))])


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'line:4' AS source_location, 'COLUMN_COUNT_MISMATCH' AS code, 'warning' AS severity FROM orders")
def csv_statement_issues(spark, sf_dir):
    return csv_statement.issues(csv_statement.parsed(_csv_files(spark, sf_dir))).select("path", "source_location", "code", "severity")


@register("""SELECT '"line:4","COLUMN_COUNT_MISMATCH","warning","","2 cells for 4 columns","",""' AS value, CAST(count(*) AS BIGINT) AS n FROM orders""")
def error_report_lines(spark, sf_dir):
    return sinks.error_report(csv_statement.issues(csv_statement.parsed(_csv_files(spark, sf_dir)))).groupBy("value").agg(F.count("*").alias("n"))


# OFX: one statement an order, every thirteenth with an impossible date.


def _ofx_files(spark, sf_dir) -> DataFrame:
    head = "OFXHEADER:100\nDATA:OFXSGML\nCHARSET:1252\n\n<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><CURDEF>USD<BANKACCTFROM><BANKID>1<ACCTID>"
    posted = "CASE WHEN o_orderkey % 13 = 0 THEN '20269902' ELSE concat(date_format(o_orderdate, 'yyyyMMdd'), '120000[-5:EST]') END"
    name = "concat(o_orderpriority, ' &amp; Co')"
    content = f"concat('{head}', lpad(o_custkey, 9, '0'), '<ACCTTYPE>SAVINGS</BANKACCTFROM><BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>', {posted}, '<TRNAMT>-', {_MONEY}, '9<FITID>F', o_orderkey, '<NAME>', {name}, '<MEMO>', CASE WHEN o_orderkey % 2 = 0 THEN {name} ELSE 'Lunch' END, '</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>10.00</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1></OFX>')"
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.encode(F.expr(content), "UTF-8").alias("content"))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'USD' AS currency, CAST(o_orderdate AS DATE) AS posted_date, CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS amount, o_orderpriority || ' & Co' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' — Lunch' END AS description, 'F' || o_orderkey AS source_id FROM orders WHERE o_orderkey % 13 <> 0")
def ofx_statement_transactions(spark, sf_dir):
    return ofx_statement.transactions(ofx_statement.parsed(_ofx_files(spark, sf_dir))).drop("statement", "row_number")


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'STMTRS:1' AS statement, CAST(1 AS BIGINT) AS row_number, 'INVALID_POSTED_DATE' AS code FROM orders WHERE o_orderkey % 13 = 0")
def ofx_statement_rejected(spark, sf_dir):
    return ofx_statement.rejected(ofx_statement.parsed(_ofx_files(spark, sf_dir)))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'STMTRS:1' AS statement, 'savings' AS account_type, 'USD' AS currency, '10.00' AS ledger_balance, CAST(NULL AS VARCHAR) AS available_balance, '••••' || right(lpad(CAST(o_custkey AS VARCHAR), 9, '0'), 4) AS masked_number FROM orders")
def ofx_statement_accounts(spark, sf_dir):
    return ofx_statement.accounts(ofx_statement.parsed(_ofx_files(spark, sf_dir))).drop("start_date", "end_date", "ledger_balance_date")


# PDF: one page a customer, signed or in two columns, dates in four forms.


def _pdf_lines(spark, sf_dir) -> DataFrame:
    day = "CAST(c_custkey % 28 + 1 AS INT)"
    when = f"element_at(array(concat('2026-07-', lpad({day}, 2, '0')), concat('7/', {day}, '/26'), concat({day}, ' July 2026'), concat('Jul ', {day}, ', 2026')), CAST(c_custkey % 4 AS INT) + 1)"
    value = "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING)"
    size = "CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) AS STRING)"
    item = lambda x, y, t: f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'width', 20D, 'text', {t})"
    signed = [item(300, 700, "'Amount'"), item(300, 681, f"CASE WHEN c_acctbal < 0 THEN concat('(', {size}, ')') ELSE concat('$', {value}) END")]
    split = [item(300, 700, "'Debit'"), item(400, 700, "'Credit'"), item("CASE WHEN c_acctbal < 0 THEN 300 ELSE 400 END", 681, size)]
    common = [item(10, 720, "'Account in CAD'"), item(10, 700, "'Date'"), item(80, 700, "'Description'"), item(10, 680, when), item(80, 679, "c_mktsegment"), item(80, 660, "'more text'"), item(10, 640, "'Closing balance'"), item(300, 640, "'1.00'")]
    both = f"CASE WHEN c_custkey % 2 = 0 THEN array({', '.join(common + signed)}) ELSE array({', '.join(common + split)}) END"
    items = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(F.expr(both)).alias("i"))
    return pdf_items.lines(items.select("doc", "page", "i.x", "i.y", "i.width", "i.text"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(1 AS BIGINT) AS row_number, make_date(2026, 7, CAST(c_custkey % 28 + 1 AS INTEGER)) AS posted_date, c_mktsegment || ' more text' AS description, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DECIMAL(38,2)) AS amount, 'page:1/line:3;page:1/line:4' AS source_location, CAST(NULL AS VARCHAR) AS issue FROM customer")
def pdf_statement_rows(spark, sf_dir):
    return pdf_items.rows(_pdf_lines(spark, sf_dir)).drop("date_text")


@register("SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(0.6 AS DOUBLE) AS score, CASE WHEN c_custkey % 2 = 0 THEN 'signed-amount' ELSE 'debit-credit' END AS mode, 'CAD' AS currency, TRUE AS supported FROM customer")
def pdf_statement_layouts(spark, sf_dir):
    """Of a page's three body lines (one above the table, the row, its continuation) one has a date and an amount."""
    return pdf_items.detected(_pdf_lines(spark, sf_dir))


@register("SELECT o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def pdf_dates(spark, sf_dir):
    """Every order's date in four forms; two-digit years are of the century that holds them."""
    raw = "element_at(array(date_format(o_orderdate, 'yyyy-MM-dd'), date_format(o_orderdate, 'M/d/yy'), date_format(o_orderdate, 'd MMM yyyy'), date_format(o_orderdate, 'MMMM d, yyyy')), CAST(o_orderkey % 4 AS INT) + 1)"
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), dates.pdf_date(F.expr(raw)).alias("parsed"))


# Cells

_RAW = "concat(CASE event_id % 6 WHEN 0 THEN '=' WHEN 1 THEN chr(9) || 'x' WHEN 2 THEN ' ' || chr(10) || '@' WHEN 3 THEN '-' ELSE '' END, event_type, repeat('y', CAST(event_id % 3 AS INTEGER) * 600))"


@register(f"WITH c AS (SELECT event_id, substr({_RAW}, 1, 1024) AS cut, substr({_RAW}, 1, 512) AS bounded FROM events) SELECT event_id, CASE WHEN event_id % 6 < 4 THEN '''' || cut ELSE cut END AS safe, bounded FROM c")
def sanitized_cells(spark, sf_dir):
    raw = F.expr(_RAW)
    return L.table(spark, sf_dir, "events").select("event_id", text.sanitized_cell(raw).alias("safe"), text.bounded(raw).alias("bounded"))


# Duplicates and transfers

_INSIDE = f"""{match_queries._BATCHES.split("e AS (SELECT *")[0]} e AS (SELECT *, {fingerprint_sql(PLAIN)} AS fp, {tokens_sql('description')} AS words FROM (SELECT * FROM existing UNION ALL SELECT * FROM incoming)),
b AS (SELECT e.txn_id AS existing_id, i.txn_id AS incoming_id, coalesce(e.source_id = i.source_id, FALSE) OR e.fp = i.fp AS exact, e.currency = i.currency AND e.amount = i.amount AS same, abs(e.posted_date - i.posted_date) AS days, {dice_sql('e.words', 'i.words')} AS similarity
  FROM e JOIN e AS i ON e.account_id = i.account_id AND (e.source_id = i.source_id OR e.fp = i.fp OR e.currency = i.currency AND e.amount = i.amount) WHERE e.txn_id < i.txn_id)"""


@register(f"{_INSIDE} SELECT existing_id, incoming_id, CASE WHEN exact THEN 'exact' ELSE 'likely' END AS kind FROM b WHERE exact OR same AND days <= 3 AND similarity >= 0.5")
def duplicates_within_batch(spark, sf_dir):
    """The ledger and a changed copy of each of its rows as one batch."""
    old, new = match_queries._batches(spark, sf_dir)
    return duplicates.within_batch(old.unionByName(new)).select("existing_id", "incoming_id", "kind")


@register(f"{match_queries._BATCHES}, k AS (SELECT incoming_id, kind FROM candidates) SELECT 'import ' || i.txn_id % 7 AS import_id, CAST(count(k.kind) FILTER (k.kind = 'exact') AS BIGINT) AS exact_duplicates, CAST(count(k.kind) FILTER (k.kind = 'likely') AS BIGINT) AS likely_duplicates FROM incoming i LEFT JOIN k ON k.incoming_id = i.txn_id GROUP BY 1")
def duplicates_by_import(spark, sf_dir):
    old, new = match_queries._batches(spark, sf_dir)
    named = new.withColumn("import_id", F.concat(F.lit("import "), (F.col("txn_id") % 7).cast("string")))
    return duplicates.import_counts(duplicates.candidates(old, new), named)


@register(f"{match_queries._BATCHES} SELECT * FROM candidates ORDER BY score DESC, CAST(existing_id AS VARCHAR), CAST(incoming_id AS VARCHAR) LIMIT 50")
def duplicates_page(spark, sf_dir):
    return orders.duplicates(duplicates.candidates(*match_queries._batches(spark, sf_dir))).limit(50)


@register(f"{match_queries._PAIRS} SELECT signature, score FROM pairs ORDER BY score DESC, signature LIMIT 50")
def transfers_page(spark, sf_dir):
    return orders.transfers(transfers.pairs(L.ledger(spark, sf_dir), max_fee="1000")).limit(50).select("signature", "score")


def _links(spark, sf_dir) -> DataFrame:
    """All pairs as links, a third of them confirmed."""
    found = transfers.pairs(L.ledger(spark, sf_dir), max_fee="1000")
    return found.select("signature", "outflow_id", "inflow_id", F.when(F.col("outflow_id") % 3 == 0, "confirmed").otherwise("proposed").alias("status"))


_LINKS = f"{match_queries._PAIRS}, links AS (SELECT signature, outflow_id, inflow_id, CASE WHEN outflow_id % 3 = 0 THEN 'confirmed' ELSE 'proposed' END AS status FROM pairs)"


@register(f"{_LINKS} SELECT outflow_id AS txn_id FROM links WHERE status = 'confirmed' UNION SELECT inflow_id FROM links WHERE status = 'confirmed'")
def transfer_confirmed_ids(spark, sf_dir):
    return transfers.confirmed_ids(_links(spark, sf_dir))


@register(f"{_LINKS} SELECT signature, outflow_id, inflow_id, CASE WHEN status = 'proposed' AND inflow_id % 3 = 0 THEN 'confirmed' WHEN status = 'proposed' AND inflow_id % 3 = 1 THEN 'rejected' WHEN status = 'confirmed' AND inflow_id % 3 = 2 THEN 'unlinked' ELSE status END AS status FROM links")
def transfer_decisions(spark, sf_dir):
    links = _links(spark, sf_dir)
    wanted = F.when(F.col("inflow_id") % 3 == 0, "confirmed").when(F.col("inflow_id") % 3 == 1, "rejected").otherwise("unlinked")
    return transfers.decided(links, links.select("signature", wanted.alias("status")))


@register(f"{_LINKS} SELECT signature, outflow_id, inflow_id, CASE WHEN status = 'confirmed' AND (outflow_id % 10 = 3 OR inflow_id % 10 = 3) THEN 'unlinked' ELSE status END AS status FROM links")
def transfer_void_cascade(spark, sf_dir):
    return duplicates.void_cascade(_links(spark, sf_dir), L.ledger(spark, sf_dir).filter("txn_id % 10 = 3"))


# The dashboard's sentences and members, the queue's and the history's order

_REPORT = "r AS ({})".format(cash_queries.QUERIES["cash_flow_by_currency"][1])


@register(f"""WITH {_REPORT}, p AS (SELECT currency, net_cash_flow AS net FROM r UNION ALL SELECT currency || '0', net_cash_flow - net_cash_flow FROM r), t AS (SELECT *, regexp_replace(regexp_replace(CAST(abs(net) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS size FROM p)
SELECT currency, CASE WHEN net = 0 THEN 'Income and spending are balanced at ' || currency || ' 0.' WHEN net > 0 THEN 'Income exceeds spending by ' || currency || ' ' || size || '.' ELSE 'Spending exceeds income by ' || currency || ' ' || size || '.' END AS takeaway FROM t""")
def dashboard_takeaways(spark, sf_dir):
    """Each currency's sentence, and that of a currency whose flows cancel out."""
    found = cash_queries.QUERIES["cash_flow_by_currency"][0](spark, sf_dir).select("currency", "net_cash_flow")
    even = found.select(F.concat("currency", F.lit("0")).alias("currency"), (F.col("net_cash_flow") - F.col("net_cash_flow")).alias("net_cash_flow"))
    return dashboard.takeaways(found.unionByName(even))


@register(f"WITH {L.LEDGER}, {L.CATEGORIES} SELECT l.currency, CASE WHEN c.kind = 'transfer' THEN 'transfer' WHEN amount >= 0 THEN 'income' ELSE 'spending' END AS flow, txn_id FROM ledger l LEFT JOIN categories c USING (category_id) WHERE status <> 'void'")
def flow_members(spark, sf_dir):
    return dashboard.group_members(cashflow.tagged(L.ledger(spark, sf_dir), L.categories(spark)), "currency")


@register(f"WITH q AS ({match_queries.QUERIES['review_queue'][1]}) SELECT txn_id, reason FROM q ORDER BY posted_date DESC, CAST(txn_id AS VARCHAR) LIMIT 50")
def review_queue_page(spark, sf_dir):
    return orders.review_queue(match_queries.QUERIES["review_queue"][0](spark, sf_dir)).limit(50).select("txn_id", "reason")


@register("SELECT event_id, ts AS occurred_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def edit_history_page(spark, sf_dir):
    return orders.history(L.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("occurred_at"))).limit(50)


# Commands


@register("""SELECT c_custkey AS account_id, 'currency' AS problem FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'type' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'name' FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'masked_identifier' FROM customer WHERE c_custkey % 7 = 0""")
def account_limits(spark, sf_dir):
    c = L.table(spark, sf_dir, "customer")
    accounts = c.select(F.col("c_custkey").alias("account_id"), F.expr("CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_name END").alias("name"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'shoe box' ELSE 'cash' END").alias("account_type"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'usd' ELSE 'USD' END").alias("currency"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN '12345' ELSE '••••1234' END").alias("masked_identifier"))
    return entities.account_problems(accounts)


@register(f"WITH {L.LEDGER} SELECT c_custkey AS account_id FROM customer WHERE c_custkey NOT IN (SELECT account_id FROM ledger WHERE status = 'void')")
def deletable_accounts(spark, sf_dir):
    """Accounts that no void row refers to."""
    accounts = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))
    return knowledge.deletable_accounts(accounts, L.ledger(spark, sf_dir).filter("status = 'void'")).select("account_id")


@register(f"WITH {L.LEDGER} SELECT txn_id, CASE WHEN txn_id % 4 = 1 AND txn_id % 8 <> 5 THEN 'proposed' ELSE category_id END AS category_id FROM ledger")
def automatic_edits(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).withColumn("category_locked", F.col("txn_id") % 8 == 5)
    return entities.automatic_edit(rows, rows.filter("txn_id % 4 = 1").select("txn_id", F.lit("proposed").alias("value")), "category_id").select("txn_id", "category_id")


@register(f"WITH {L.LEDGER} SELECT txn_id, CASE WHEN txn_id % 5 = 0 THEN 'edited' ELSE notes END AS notes FROM ledger")
def operation_applied(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).select("txn_id", "notes")
    changes = rows.filter("txn_id % 5 = 0").select("txn_id", F.struct("notes").alias("before"), F.struct(F.lit("edited").alias("notes")).alias("after"))
    return entities.apply_operation(rows, changes, "txn_id")


@register(f"WITH {L.LEDGER} SELECT txn_id, notes FROM ledger")
def operation_undone(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).select("txn_id", "notes")
    changes = rows.filter("txn_id % 5 = 0").select("txn_id", F.struct("notes").alias("before"), F.struct(F.lit("edited").alias("notes")).alias("after"))
    return entities.undo_operation(entities.apply_operation(rows, changes, "txn_id"), changes, "txn_id")


_ITEMS_PAGE = match_queries.QUERIES["recurring_proposals"][1]


@register(f"WITH q AS ({_ITEMS_PAGE}) SELECT signature, confidence FROM q ORDER BY confidence DESC, signature LIMIT 50")
def recurring_page(spark, sf_dir):
    return orders.recurring(match_queries.QUERIES["recurring_proposals"][0](spark, sf_dir)).limit(50).select("signature", "confidence")
