"""Scalar functions over the tables' own texts, and the readers' parsing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinbrook.functions import dates, money, text
from coinbrook.operators import duplicates
from coinbrook.plans import ledgers as L
from coinbrook.sources import mapping

QUERIES: dict = {}


def register(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


#: What the merchant normalizer does to ASCII text, word by word: RE2 has no look-around.
def merchant_sql(x: str) -> str:
    out = f"lower({x})"
    for pattern, by in ((r"^(?:sq\s*\*|tst\s*\*|paypal\s*\*|sp\s*\*|vcg\s*\*|pos\s+|db\s+)", ""), (r"(?:#\s*\d+|store\s*#?\s*\d+|term(?:inal)?\s*#?\s*\d+|loc(?:ation)?\s*#?\s*\d+|ref\s*#?\s*\d+)", " "), (r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b|\b\d{4}-\d{2}-\d{2}\b", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    # Words of four and more letters and digits with a digit go, whole words only.
    parts = f"regexp_extract_all({out}, '[a-z0-9_]+|[^a-z0-9_]+')"
    kept = f"list_transform({parts}, lambda p: CASE WHEN regexp_full_match(p, '[a-z0-9]{{4,}}') AND regexp_matches(p, '[0-9]') THEN ' ' ELSE p END)"
    return f"trim(regexp_replace(regexp_replace(array_to_string({kept}, ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_RAW = "concat(CASE o_orderkey % 5 WHEN 0 THEN 'TST* ' WHEN 1 THEN 'SQ *' WHEN 2 THEN 'pos ' WHEN 3 THEN 'VCG * ' ELSE '' END, o_orderpriority, ' Store #', o_orderkey % 500, ' ref ', o_custkey, ' ab', o_orderkey % 1000, 'x 12/', o_orderkey % 28 + 1, ' 2024-01-0', o_orderkey % 9 + 1, ' term')"


@register(f"SELECT o_orderkey AS txn_id, {merchant_sql(_RAW)} AS normalized FROM orders")
def normalize_merchant(spark, sf_dir):
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), text.normalize_merchant(F.expr(_RAW)).alias("normalized"))


@register(f"SELECT o_orderkey AS txn_id, trim(regexp_replace(regexp_replace(upper({_RAW}), '[0-9]', '', 'g'), '\\s+', ' ', 'g')) AS normalized FROM orders")
def normalize_recurring(spark, sf_dir):
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), text.normalize_recurring(F.expr(_RAW)).alias("normalized"))


@register(f"SELECT o_orderkey AS txn_id, trim(regexp_replace(lower({_RAW}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS normalized FROM orders")
def normalize_duplicate(spark, sf_dir):
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), text.normalize_duplicate(F.expr(_RAW)).alias("normalized"))


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> ''))"


def dice_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


@register(f"WITH p AS (SELECT p_partkey, {tokens_sql('p_name')} AS a, {tokens_sql('p_type')} AS b, {tokens_sql('p_brand')} AS c FROM part) SELECT p_partkey, round(CAST({dice_sql('list_concat(a, c)', 'list_concat(c, b)')} AS DOUBLE), 6) AS similarity FROM p")
def dice_similarity(spark, sf_dir):
    t = lambda c: text.tokens(text.normalize_duplicate(F.col(c)))
    left, right = F.concat(t("p_name"), t("p_brand")), F.concat(t("p_brand"), t("p_type"))
    return L.table(spark, sf_dir, "part").select("p_partkey", F.round(text.dice(left, right), 6).alias("similarity"))


PLAIN = "CASE WHEN contains(CAST(amount AS VARCHAR), '.') THEN regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '0+$', ''), '\\.$', '') ELSE CAST(amount AS VARCHAR) END"


def fingerprint_sql(amount: str = PLAIN) -> str:
    return f"sha256(concat_ws(chr(0), 'transaction-fingerprint-v1', CAST(account_id AS VARCHAR), CAST(posted_date AS VARCHAR), {amount}, currency, lower(description)))"


@register(f"WITH {L.LEDGER} SELECT txn_id, {fingerprint_sql()} AS fingerprint FROM ledger")
def fingerprint_sha256(spark, sf_dir):
    return L.ledger(spark, sf_dir).select("txn_id", duplicates.fingerprint(F.lower(text.nfkc(F.col("description")))).alias("fingerprint"))


_CELL = "concat(CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '@' WHEN 3 THEN '-' WHEN 4 THEN 'a,\"' ELSE '' END, event_type)"


@register(f"WITH c AS (SELECT event_id, {_CELL} AS cell FROM events), s AS (SELECT event_id, CASE WHEN regexp_matches(cell, '^[\\t\\r\\n ]*[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END AS safe FROM c) SELECT event_id, safe, CASE WHEN regexp_matches(safe, '[\",\\r\\n]') THEN '\"' || replace(safe, '\"', '\"\"') || '\"' ELSE safe END AS cell FROM s")
def spreadsheet_safe(spark, sf_dir):
    safe = text.spreadsheet_safe(F.expr(_CELL))
    return L.table(spark, sf_dir, "events").select("event_id", safe.alias("safe"), text.csv_cell(safe).alias("cell"))


_NUMBER = "concat(CASE o_orderkey % 6 WHEN 0 THEN '$' WHEN 1 THEN '(' WHEN 2 THEN '-' WHEN 3 THEN 'EUR ' WHEN 4 THEN '+' ELSE '' END, CASE WHEN o_orderkey % 10 = 9 THEN '1,23' WHEN o_orderkey % 10 = 8 THEN '12.345' ELSE concat(o_orderkey % 900 + 100, ',', o_custkey % 900 + 100, '.', o_orderkey % 90 + 10) END, CASE WHEN o_orderkey % 6 = 1 THEN ')' WHEN o_orderkey % 6 = 5 THEN ' USD' ELSE '' END)"


@register(f"SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 10 < 8 THEN CAST(CASE WHEN o_orderkey % 6 IN (1, 2) THEN -1 ELSE 1 END * ((o_orderkey % 900 + 100) * 1000 + o_custkey % 900 + 100 + CAST(o_orderkey % 90 + 10 AS DECIMAL(4,2)) * CAST(0.01 AS DECIMAL(3,2))) AS DECIMAL(38,2)) END AS amount FROM orders")
def number_parse(spark, sf_dir):
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), money.parse_locale_number(F.expr(_NUMBER)).alias("amount"))


@register("SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 31 + 1 <= 29 THEN make_date(2024, 2, CAST(o_orderkey % 31 + 1 AS INTEGER)) END AS parsed FROM orders")
def date_parse(spark, sf_dir):
    raw = F.expr("concat(lpad(o_orderkey % 31 + 1, 2, '0'), '/02/2024')")
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), dates.strict_date(raw, "DD/MM/YYYY").alias("parsed"))


def import_rows(spark, sf_dir):
    """Orders as parsed rows of a statement, some with wrong values."""
    o = L.table(spark, sf_dir, "orders")
    value = lambda e: F.expr(e)
    fields = F.create_map(
        F.lit("Date"), value("CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"), F.lit("Text"), value("CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE concat(' ', o_orderpriority, '  x ') END"),
        F.lit("Out"), value("CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) ELSE '' END"), F.lit("In"), value("CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 19 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) ELSE '' END"),
    )
    return o.select(F.lit("orders").alias("path"), F.col("o_orderkey").alias("row_number"), F.concat(F.lit("line:"), F.col("o_orderkey").cast("string")).alias("source_location"), fields.alias("fields"))


MAPPING = mapping.Mapping("a1", "USD", "Date", "Text", debit="Out", credit="In")
_IMPORT = """m AS (SELECT o_orderkey, 'line:' || o_orderkey AS source_location, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_date, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority || ' x' ELSE '' END AS description,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders),
ok AS (SELECT *, posted_date IS NOT NULL AND description <> '' AND amount IS NOT NULL AS valid FROM m)"""


@register(f"WITH {_IMPORT} SELECT source_location, posted_date, description, CAST(amount AS DECIMAL(38,2)) AS amount FROM ok WHERE valid")
def csv_map_candidates(spark, sf_dir):
    return mapping.candidates(import_rows(spark, sf_dir), MAPPING).select("source_location", "posted_date", "description", "amount")


@register(f"WITH {_IMPORT} SELECT 'INVALID_POSTED_DATE' AS code, source_location, '•••• (4 characters)' AS rejected FROM ok WHERE posted_date IS NULL UNION ALL SELECT 'INVALID_DESCRIPTION', source_location, 'blank value' FROM ok WHERE description = '' UNION ALL SELECT 'INVALID_AMOUNT', source_location, NULL FROM ok WHERE amount IS NULL")
def csv_issues(spark, sf_dir):
    out = mapping.issues(import_rows(spark, sf_dir), MAPPING)
    return out.select("code", "source_location", F.when(F.col("code") != "INVALID_AMOUNT", F.col("rejected")).alias("rejected"))


@register(f"WITH {_IMPORT} SELECT CAST(sum(CASE WHEN valid AND amount > 0 THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS inflow, CAST(sum(CASE WHEN valid AND amount < 0 THEN -amount ELSE 0 END) AS DECIMAL(38,2)) AS outflow, CAST(count(*) FILTER (valid) AS BIGINT) AS n_valid, CAST(count(*) FILTER (NOT valid) AS BIGINT) AS n_invalid, count(*) FILTER (NOT valid) = 0 AS can_continue FROM ok")
def import_totals(spark, sf_dir):
    return mapping.totals(import_rows(spark, sf_dir), MAPPING)


@register(
    f"WITH {_IMPORT}, k AS (SELECT *, CASE WHEN NOT valid THEN 0 WHEN amount < 0 THEN 1 WHEN amount > 0 THEN 2 ELSE 3 END AS kind FROM ok), f AS (SELECT *, CASE WHEN kind < 3 AND o_orderkey = min(o_orderkey) OVER (PARTITION BY kind) THEN kind ELSE 9 END AS r FROM k) SELECT o_orderkey AS row_number, source_location, CASE WHEN valid THEN 'valid' ELSE 'invalid' END AS row_status FROM f ORDER BY r, o_orderkey LIMIT 20"
)
def preview_rows(spark, sf_dir):
    return mapping.preview(import_rows(spark, sf_dir), MAPPING).select("row_number", "source_location", "row_status")
