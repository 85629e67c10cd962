"""Money columns: exact decimals, always beside a currency.

Zero counts as an inflow everywhere but in import totals. A textual negative zero is
zero here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"
TOTAL = "decimal(38,2)"


def is_inflow(amount: Column) -> Column:
    return amount >= 0


def is_outflow(amount: Column) -> Column:
    return amount < 0


def total(amount: Column, condition: Column | None = None) -> Column:
    """Sum as DECIMAL(38,2), zero where nothing counts."""
    value = amount if condition is None else F.when(condition, amount)
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, rounded half up; null where whole is zero. The operands are narrowed first, so that the quotient keeps 18 places before it is rounded."""
    narrow = "decimal(20,2)"
    return F.when(whole != 0, F.round(part.cast(narrow) / F.nullif(whole, F.lit(0)).cast(narrow), digits)).cast(f"decimal(18,{digits})")


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    narrow = "decimal(20,2)"
    return F.when(whole != 0, F.round(100 * part.cast(narrow) / F.nullif(whole, F.lit(0)).cast(narrow), digits)).cast(f"decimal(18,{digits})")


def render(amount: Column) -> Column:
    """Canonical text: no trailing zeros, no point without digits behind it."""
    plain = amount.cast("string")
    return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)


def is_money_text(text: Column) -> Column:
    """Whether ``text`` is a plain decimal number without leading zeros."""
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$")


def parse_locale_number(text: Column, decimal: str = ".", grouping: str | None = ",") -> Column:
    """DECIMAL(38,2) of a statement's number; null if it is none.

    Currency signs anywhere, a currency code at either end, parentheses or one leading
    sign, groups of exactly three digits and at most two decimals are understood.
    ``text`` is in NFKC form.
    """
    d = re.escape(decimal)
    t = F.trim(text)
    enclosed = t.rlike(r"^\(.*\)$")
    t = F.trim(F.when(enclosed, F.regexp_extract(t, r"^\((.*)\)$", 1)).otherwise(t))
    t = F.trim(F.regexp_replace(t, r"\p{Sc}", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)^[A-Z]{3}\s*", ""), r"(?i)\s*[A-Z]{3}$", ""))
    signed = t.rlike(r"^[+-]")
    minus = t.startswith("-")
    plain = F.regexp_replace(t, r"^[+-]", "")
    whole = rf"([0-9]{{1,3}}({re.escape(grouping)}[0-9]{{3}})+|[0-9]+)" if grouping else r"[0-9]+"
    ok = plain.rlike(rf"^{whole}({d}[0-9]{{0,2}})?$") & ~(enclosed & signed)
    digits = F.replace(plain, F.lit(grouping), F.lit("")) if grouping else plain
    number = F.regexp_replace(F.replace(digits, F.lit(decimal), F.lit(".")), r"\.$", "").try_cast("decimal(38,2)")
    return F.when(ok, F.when(enclosed | minus, -number).otherwise(number)).cast("decimal(38,2)")


def signed_from_columns(debit: Column, credit: Column) -> Column:
    """One of two magnitudes as a signed amount; null unless exactly one is given."""
    return F.when(debit.isNotNull() & credit.isNull(), -F.abs(debit)).when(credit.isNotNull() & debit.isNull(), F.abs(credit))
