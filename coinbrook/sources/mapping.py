"""Parsed rows to transaction candidates: mapped columns, issues, totals and preview."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.functions import dates, money, text


@dataclass(frozen=True)
class Mapping:
    """Which field holds what. Either ``amount`` or both ``debit`` and ``credit``."""

    account_id: str
    currency: str
    posted: str
    description: str
    date_format: str = "YYYY-MM-DD"
    amount: str | None = None
    debit: str | None = None
    credit: str | None = None
    positive_is_inflow: bool = True
    decimal: str = "."
    grouping: str | None = ","
    currency_column: str | None = None
    source_id: str | None = None
    status: str | None = None

    def __post_init__(self):
        if (self.amount is None) == (self.debit is None or self.credit is None):
            raise ValueError("map one signed amount, or debit and credit")
        if self.decimal == self.grouping:
            raise ValueError("decimal and grouping signs are the same")
        if self.date_format not in dates.FORMATS:
            raise ValueError(f"not a date format: {self.date_format}")


def _field(name: str | None) -> Column:
    return F.col("fields")[name] if name else F.lit(None).cast("string")


def mapped(rows: DataFrame, m: Mapping) -> DataFrame:
    """``rows`` with their candidate columns and ``bad``, the fields that are wrong; null where nothing is."""
    number = lambda c: money.parse_locale_number(text.nfkc(_field(c)), m.decimal, m.grouping)
    if m.amount:
        value = number(m.amount) if m.positive_is_inflow else -number(m.amount)
        raw = F.coalesce(_field(m.amount), F.lit(""))
    else:
        value = money.signed_from_columns(number(m.debit), number(m.credit))
        raw = F.concat_ws(" | ", F.coalesce(_field(m.debit), F.lit("")), F.coalesce(_field(m.credit), F.lit("")))
    posted = dates.strict_date(_field(m.posted), m.date_format)
    described = text.normalize_import(F.coalesce(_field(m.description), F.lit("")))
    currency = F.upper(F.trim(_field(m.currency_column))) if m.currency_column else F.lit(m.currency)
    source_id, status = F.nullif(F.trim(_field(m.source_id)), F.lit("")), F.lower(F.nullif(F.trim(_field(m.status)), F.lit("")))
    out = rows.withColumns({"posted_date": posted, "description": described, "amount": value.cast("decimal(38,2)"), "currency": currency, "source_id": source_id, "status": status})
    wrong = {
        "postedDate": (F.col("posted_date").isNull(), F.coalesce(_field(m.posted), F.lit(""))),
        "description": (~F.length("description").between(1, 1000), F.coalesce(_field(m.description), F.lit(""))),
        "amount": (F.col("amount").isNull(), raw),
        "currency": (~F.col("currency").eqNullSafe(F.lit(m.currency)), F.coalesce(F.col("currency"), F.lit(""))),
        "sourceTransactionId": (F.coalesce(F.length("source_id") > 240, F.lit(False)), F.coalesce("source_id", F.lit(""))),
        "status": (F.coalesce(~F.col("status").isin("pending", "posted", "void"), F.lit(False)), F.coalesce("status", F.lit(""))),
    }
    items = [F.when(cond, F.struct(F.lit(name).alias("field"), rejected.alias("rejected"))) for name, (cond, rejected) in wrong.items()]
    return out.withColumn("bad", F.filter(F.array(*items), lambda x: x.isNotNull()))


def candidates(rows: DataFrame, m: Mapping) -> DataFrame:
    """Rows without an error, as transactions to be."""
    good = mapped(rows, m).filter(F.size("bad") == 0)
    return good.select(F.lit(m.account_id).alias("account_id"), "posted_date", "description", "amount", "currency", "source_id", "status", "path", "source_location")


def issues(rows: DataFrame, m: Mapping) -> DataFrame:
    """code, severity, source_location, field and a masked summary of what was rejected."""
    each = mapped(rows, m).select("path", "source_location", F.explode("bad").alias("b"))
    return each.select(text.issue_code(F.col("b.field")).alias("code"), F.lit("error").alias("severity"), "path", "source_location", "b.field", text.rejected_summary(F.col("b.rejected")).alias("rejected"))


def totals(rows: DataFrame, m: Mapping) -> DataFrame:
    """Inflow and outflow (zero is neither), valid and invalid rows, and whether the import may go on."""
    ok = F.size("bad") == 0
    return mapped(rows, m).agg(
        money.total(F.col("amount"), ok & (F.col("amount") > 0)).alias("inflow"), money.total(-F.col("amount"), ok & (F.col("amount") < 0)).alias("outflow"),
        money.count_if(ok).alias("n_valid"), money.count_if(~ok).alias("n_invalid"), (F.count_if(~ok) == 0).alias("can_continue"),
    )


def preview(rows: DataFrame, m: Mapping, order: str = "row_number", size: int = 20) -> DataFrame:
    """Up to ``size`` rows: the first invalid one, the first outflow, the first inflow above zero, then in order."""
    all_rows = mapped(rows, m).withColumn("valid", F.size("bad") == 0)
    kind = F.when(~F.col("valid"), 0).when(F.col("amount") < 0, 1).when(F.col("amount") > 0, 2).otherwise(3)
    typed = all_rows.withColumn("kind", kind)
    # Three minima find the shown ones; no window over the whole import.
    firsts = typed.filter("kind < 3").groupBy("kind").agg(F.min(order).alias(order)).withColumn("chosen", F.lit(True))
    marked = typed.join(F.broadcast(firsts), ["kind", order], "left")
    rank = F.when(F.col("chosen"), F.col("kind")).otherwise(9)
    return marked.orderBy(rank, order).limit(size).select(order, "source_location", F.when(F.col("valid"), "valid").otherwise("invalid").alias("row_status"), "posted_date", "description", "amount")


def header_signature(header: list[str], parser_id: str = "csv", parser_version: str = "1.0.0") -> str:
    """Key of a saved mapping: FNV-1a over the code points of parser, version and the header's composed names in small letters."""
    names = "\x1f".join(unicodedata.normalize("NFKC", x).strip().lower() for x in header)
    h = 0x811C9DC5
    for character in f"{parser_id}\x00{parser_version}\x00{names}":
        h = ((h ^ ord(character)) * 0x01000193) & 0xFFFFFFFF
    return f"csv-{h:08x}"


def accepted_exactly(candidates_: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (path, source_location) that are not a candidate exactly once."""
    dealt = candidates_.groupBy("path", "source_location").agg(F.count("*").alias("n"))
    return rows.select("path", "source_location").join(dealt, ["path", "source_location"], "left").filter("n is null or n <> 1").select("path", "source_location")


def drafts(df: DataFrame, account_currency: str) -> DataFrame:
    """Drafts of other formats (posted_date, description, amount, currency) with their problem, null if they can be taken."""
    problem = F.when(F.col("posted_date").isNull(), "postedDate").when(~F.length("description").between(1, 1000), "description").when(F.col("amount").isNull(), "amount").when(F.col("currency") != account_currency, "currency")
    return df.withColumn("problem", problem)


#: Fixed limits and pattern of drafts.
MAX_DESCRIPTION, MAX_SOURCE_ID = 1000, 240
DRAFT_AMOUNT = r"^-?[0-9]+\.[0-9]{2}$"


def _day(c: str) -> Column:
    return F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull()


def checked_drafts(df: DataFrame, account_currency: str) -> DataFrame:
    """Drafts of other formats as texts (posted_date, transaction_date, description, amount, currency, source_id) with ``bad``, the fields that can't be taken, in that order.

    Days exist, amounts have two decimals, descriptions and identifiers are within their
    limits, and the currency is the account's. A transaction date may be null or empty, an
    identifier null; any other null is bad. An account without a currency is refused.
    """
    if not re.fullmatch("[A-Z]{3}", account_currency):
        raise ValueError("the account needs a currency of three capital letters")
    good = {
        "posted_date": _day("posted_date"),
        "transaction_date": F.coalesce("transaction_date", F.lit("")).eqNullSafe("") | _day("transaction_date"),
        "description": text.utf16_length(F.col("description")).between(1, MAX_DESCRIPTION),
        "amount": F.col("amount").rlike(DRAFT_AMOUNT),
        "currency": F.col("currency") == account_currency,
        "source_id": text.utf16_length(F.col("source_id")) <= MAX_SOURCE_ID,
    }
    return df.withColumn("bad", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in good.items()]), lambda c: c.isNotNull()))


def draft_totals(checked: DataFrame) -> DataFrame:
    """One row: inflow and outflow of the usable drafts, valid_rows, invalid_rows and can_continue (none is invalid; true for no drafts)."""
    value, ok = F.col("amount").try_cast("decimal(38,2)"), F.size("bad") == 0
    total = lambda c: F.coalesce(F.sum(F.when(ok & c, F.abs(value))), F.lit(0)).cast("decimal(38,2)")
    n = checked.agg(total(value > 0).alias("inflow"), total(value < 0).alias("outflow"), money.count_if(ok).alias("valid_rows"), money.count_if(~ok).alias("invalid_rows"))
    return n.withColumn("can_continue", F.col("invalid_rows") == 0)


#: What keeps an import from being committed.
COMMIT_PROBLEMS = ("no source", "source twice", "source with errors", "other account", "other currency", "source not selected", "other parser", "identifier twice", "rows are not candidates one to one")


def commit_problems(candidates_: DataFrame, sources: DataFrame, account_id: str, currency: str) -> DataFrame:
    """problem, subject (digest or identifier, null for the import as a whole) and n, nothing if the import can be committed.

    candidates_: sha256, account_id, currency, parser_id, parser_version, source_id.
    sources: sha256, parser_id, parser_version, source_rows, n_errors, a row a file. Rows are
    counted by file before any join, so that one large file is no hot key; null identifiers
    repeat freely.
    """
    say = lambda df, k, subject="sha256", n="n": df.select(F.lit(COMMIT_PROBLEMS[k]).alias("problem"), (F.col(subject) if subject else F.lit(None)).cast("string").alias("subject"), F.col(n).cast("long").alias("n"))
    parsers = ["parser_id", "parser_version"]
    dealt = candidates_.groupBy("sha256", "account_id", "currency", *parsers).agg(F.count("*").alias("n"))
    known = sources.groupBy("sha256").agg(F.count("*").alias("times"), F.first("source_rows").alias("source_rows"), F.max("n_errors").alias("n_errors"), *[F.first(c).alias(f"own_{c}") for c in parsers])
    met = dealt.join(known, "sha256", "left")
    differs = ~(F.col("parser_id").eqNullSafe(F.col("own_parser_id")) & F.col("parser_version").eqNullSafe(F.col("own_parser_version")))
    by_file = lambda df: df.groupBy("sha256").agg(F.sum("n").alias("n"))
    counted = known.join(by_file(dealt), "sha256", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = (
        say(sources.agg(F.count("*").alias("n")).filter("n = 0"), 0, None),
        say(known.filter("times > 1"), 1, n="times"),
        say(known.filter("n_errors > 0"), 2, n="n_errors"),
        say(dealt.filter(~F.col("account_id").eqNullSafe(account_id)).agg(F.sum("n").alias("n")).filter("n > 0"), 3, None),
        say(dealt.filter(~F.col("currency").eqNullSafe(currency)).agg(F.sum("n").alias("n")).filter("n > 0"), 4, None),
        say(by_file(met.filter("times is null")), 5),
        say(by_file(met.filter(F.col("times").isNotNull() & differs)), 6),
        say(candidates_.filter("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 1"), 7, "source_id"),
        say(counted.filter(~F.col("n").eqNullSafe(F.col("source_rows"))), 8),
    )
    return reduce(DataFrame.unionByName, found)


def ordered_issues(found: DataFrame, limit: int = 1000) -> DataFrame:
    """The first issues, and a marker if there are more; the rank runs in each file."""
    w = Window.partitionBy("path").orderBy("source_location", "field")
    ranked = found.withColumn("rank", F.row_number().over(w))
    over = ranked.filter(F.col("rank") == limit + 1).select(F.lit("ISSUE_LIMIT_REACHED").alias("code"), F.lit("warning").alias("severity"), "path", F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("rejected"))
    return ranked.filter(F.col("rank") <= limit).drop("rank").unionByName(over)
