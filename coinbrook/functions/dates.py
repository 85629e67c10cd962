"""Date columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statement date formats: pattern of the text, and Spark's format.
FORMATS = {
    "YYYY-MM-DD": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    "MM/DD/YYYY": (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"),
    "DD/MM/YYYY": (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"),
    "YYYY/MM/DD": (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
}


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def incomplete_month(month_first: Column, as_of: date, since: date | None = None, until: date | None = None) -> Column:
    """Whether the month is not over at ``as_of``, or a filter's range cuts it."""
    last = F.last_day(month_first)
    out = F.lit(as_of) < last
    if since:
        out |= F.lit(since) > month_first
    if until:
        out |= F.lit(until) < last
    return out


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def strict_date(text: Column, form: str) -> Column:
    """A real, zero-padded date in one of FORMATS; else null."""
    pattern, spark_format = FORMATS[form]
    return F.when(F.trim(text).rlike(pattern), F.try_to_date(F.trim(text), spark_format))


def ofx_date(text: Column) -> Column:
    """The day of YYYYMMDD[HHMMSS[.XXX]][[offset:zone]]; the offset is checked and not applied."""
    ok = text.rlike(r"^[0-9]{8}([0-9]{4}([0-9]{2}(\.[0-9]{1,3})?)?)?(\[[+-]?[0-9]{1,2}(\.[0-9]{1,2})?(:[A-Za-z]+)?\])?$")
    return F.when(ok, F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def utc_timestamp(text: Column) -> Column:
    """RFC 3339 with Z only; else null."""
    ok = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?Z$")
    return F.when(ok, text.try_cast("timestamp"))


#: Fixed patterns of dates in statements' text, in lower case; the months' names by their first three letters.
_PDF_DATES = (r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", r"^(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4})$", r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def looks_like_pdf_date(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = low.rlike(_PDF_DATES[0])
    for pattern in _PDF_DATES[1:]:
        out = out | low.rlike(pattern)
    return out


def pdf_date(text: Column, day_first: bool = False) -> Column:
    """The day of 2026-07-01, 7/1/26 (day_first: 1/7/26), 1 Jul 2026 or Jul 1, 2026; two-digit years up to 68 are of this century. Null for what is none."""
    low = F.lower(F.trim(text))
    part = lambda k, n: F.regexp_extract(low, _PDF_DATES[k], n)
    number = lambda k, n: part(k, n).try_cast("int")
    month = lambda k, n: F.array_position(F.array(*map(F.lit, MONTHS)), part(k, n)).cast("int")
    short = number(1, 3)
    year = F.when(short >= 100, short).when(short <= 68, short + 2000).otherwise(short + 1900)
    a, b = number(1, 1), number(1, 2)
    forms = ((number(0, 1), number(0, 2), number(0, 3)), (year, b, a) if day_first else (year, a, b), (number(2, 3), month(2, 2), number(2, 1)), (number(3, 3), month(3, 1), number(3, 2)))
    out = F.lit(None).cast("date")
    for k, (y, m, d) in reversed(list(enumerate(forms))):
        out = F.when(low.rlike(_PDF_DATES[k]), F.when(y >= 1, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))).otherwise(out)
    return out
