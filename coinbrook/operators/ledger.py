"""Filters, order, pages, edits and export of a ledger.

A ledger has the columns txn_id, account_id, posted_date, amount, currency,
description, status, review_state, merchant_id, category_id, tags and notes.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions import money, text

STATUSES = ("posted", "pending", "void")
REVIEW_STATES = ("unreviewed", "needsReview", "reviewed")


@dataclass(frozen=True)
class CashFlowFilter:
    """All conditions hold together; an empty tuple matches nothing, None matches all. Tags: any of them."""

    account_ids: tuple | None = None
    category_ids: tuple | None = None
    currencies: tuple | None = None
    merchant_ids: tuple | None = None
    tags: tuple | None = None
    review_states: tuple | None = None
    since: date | None = None
    until: date | None = None

    def __post_init__(self):
        if self.since and self.until and self.since > self.until:
            raise ValueError("the start date must not be after the end date")
        for c in self.currencies or ():
            if not (len(c) == 3 and c.isascii() and c.isupper()):
                raise ValueError(f"not a currency: {c!r}")
        for t in self.tags or ():
            if not 1 <= len(t.strip()) <= 80:
                raise ValueError("a tag has 1 to 80 characters")
        for s in self.review_states or ():
            if s not in REVIEW_STATES:
                raise ValueError(f"not a review state: {s!r}")

    def condition(self) -> Column:
        out = F.lit(True)
        for values, column in ((self.account_ids, "account_id"), (self.category_ids, "category_id"), (self.currencies, "currency"), (self.merchant_ids, "merchant_id"), (self.review_states, "review_state")):
            if values is not None:
                out &= F.col(column).isin(*values) & F.col(column).isNotNull() if values else F.lit(False)
        if self.tags is not None:
            out &= F.arrays_overlap("tags", F.array(*[F.lit(t.strip()) for t in self.tags])) if self.tags else F.lit(False)
        if self.since:
            out &= F.col("posted_date") >= F.lit(self.since)
        if self.until:
            out &= F.col("posted_date") <= F.lit(self.until)
        return out

    def described(self, n_transactions: int | None = None, recurring_statuses: tuple | None = None) -> str:
        """The filter in one line; chosen transactions and recurring states are no part of it and come as arguments."""
        # The wording of each part.
        counted = lambda values, noun, every: every if values is None else f"{len(values)} {noun}(s)"
        listed = lambda values, every: every if values is None else ", ".join(values)
        dates = "All dates" if self.since is None and self.until is None else f"{self.since or 'Beginning'} to {self.until or 'Today'}"
        parts = [
            "all transactions" if n_transactions is None else f"{n_transactions} selected transaction(s)",
            dates,
            counted(self.account_ids, "account", "all accounts"),
            listed(self.currencies, "all currencies"),
            counted(self.category_ids, "category", "all categories"),
            counted(self.merchant_ids, "merchant", "all merchants"),
            counted(self.tags, "tag", "all tags"),
            listed(self.review_states, "all review states"),
            listed(recurring_statuses, "all recurring states"),
        ]
        return " · ".join(parts)


def apply_filter(ledger: DataFrame, flt: CashFlowFilter | None = None, transaction_ids: DataFrame | None = None) -> DataFrame:
    """Rows that ``flt`` keeps; ``transaction_ids`` (txn_id) is a semi-join, however long."""
    out = ledger.filter((flt or CashFlowFilter()).condition())
    return out.join(transaction_ids.select("txn_id"), "txn_id", "left_semi") if transaction_ids is not None else out


@dataclass(frozen=True)
class LedgerFilter(CashFlowFilter):
    """The ledger view's filter. Tags: all of them, without regard to case; search: a part of description, notes and tags; amounts: signed, in one currency."""

    uncategorized: bool = False
    statuses: tuple | None = None
    directions: tuple | None = None
    search: str | None = None
    minimum: Decimal | None = None
    maximum: Decimal | None = None

    def __post_init__(self):
        if (self.minimum is not None or self.maximum is not None) and len(self.currencies or ()) != 1:
            raise ValueError("an amount range needs one currency")

    def condition(self) -> Column:
        plain = CashFlowFilter(self.account_ids, None, self.currencies, self.merchant_ids, None, self.review_states)
        out = plain.condition()
        if self.since:
            out &= F.col("posted_date") >= F.lit(self.since)
        if self.until:
            out &= F.col("posted_date") <= F.lit(self.until)
        if self.category_ids is not None or self.uncategorized:
            listed = F.col("category_id").isin(*self.category_ids) & F.col("category_id").isNotNull() if self.category_ids else F.lit(False)
            out &= (F.col("category_id").isNull() | listed) if self.uncategorized else listed
        if self.statuses is not None:
            out &= F.col("status").isin(*self.statuses) if self.statuses else F.lit(False)
        if self.directions is not None:
            # Zero is an inflow, so the direction "zero" has no rows.
            one = {"inflow": money.is_inflow(F.col("amount")), "outflow": money.is_outflow(F.col("amount")), "zero": F.lit(False)}
            either = F.lit(False)
            for d in self.directions:
                either |= one[d]
            out &= either
        if self.tags is not None:
            wanted = F.array(*[text.nfkc(F.lower(F.lit(t.strip()))) for t in self.tags]).cast("array<string>")
            own = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
            out &= F.size(F.array_except(wanted, own)) == 0
        if self.search and self.search.strip():
            out &= search_text().contains(F.lower(text.nfkc(F.lit(self.search.strip()))))
        if self.minimum is not None:
            out &= F.col("amount") >= F.lit(self.minimum)
        if self.maximum is not None:
            out &= F.col("amount") <= F.lit(self.maximum)
        return out


def search_text() -> Column:
    """What a search looks into."""
    return F.lower(text.nfkc(F.concat_ws(" ", "description", "notes", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))))


SORTS = {"posted_date": ("posted_date",), "amount": ("currency", "amount"), "description": ("description",), "review_state": ("review_state",)}


def ordered(ledger: DataFrame, sort: str = "posted_date", descending: bool = True) -> DataFrame:
    """In order of ``sort``, ties by id; descending turns the whole order round."""
    keys = [F.col(c) for c in (*SORTS[sort], "txn_id")]
    if sort == "description":
        keys[0] = F.collate("description", "UNICODE")
    return ledger.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def page(ledger: DataFrame, flt: LedgerFilter | None = None, sort: str = "posted_date", descending: bool = True, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered ledger, and the total before paging (one row)."""
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("offset from 0, limit from 1 to 1000")
    rows = ledger.filter((flt or LedgerFilter()).condition())
    return ordered(rows, sort, descending).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


EXPORT_COLUMNS = ("transaction_id", "posted_date", "account", "description", "amount", "currency", "category", "status", "review_state", "tags", "filter")


def export_projection(ledger: DataFrame, accounts: DataFrame, categories: DataFrame, summary: str) -> DataFrame:
    """The export's columns as text, names joined in, voids included; cells are safe for spreadsheets but not yet quoted."""
    a = accounts.select("account_id", F.col("name").alias("account_name"))
    c = categories.select("category_id", F.col("name").alias("category_name"))
    rows = ledger.join(a, "account_id", "left").join(c, "category_id", "left")
    safe = text.spreadsheet_safe
    return rows.select(
        F.col("txn_id").cast("string").alias("transaction_id"),
        F.col("posted_date").cast("string").alias("posted_date"),
        safe(F.coalesce("account_name", F.lit("Unknown account"))).alias("account"),
        safe(F.col("description")).alias("description"),
        money.render(F.col("amount")).alias("amount"),
        "currency",
        safe(F.when(F.col("category_id").isNull(), "Uncategorized").otherwise(F.coalesce("category_name", F.lit("Unknown category")))).alias("category"),
        "status",
        "review_state",
        safe(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ";")).alias("tags"),
        F.lit(summary).alias("filter"),
    )


def write_export(rows: DataFrame, path: str) -> None:
    """CSV with CRLF ends, cells quoted only if needed; a header line in each part file."""
    line = F.concat_ws(",", *[text.csv_cell(F.col(c)) for c in EXPORT_COLUMNS])
    header = rows.sparkSession.createDataFrame([(",".join(EXPORT_COLUMNS),)], "value string")
    header.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    rows.select(line.alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")


@dataclass(frozen=True)
class Edit:
    """A bulk edit; a field that is not given stays. ``clear_category`` empties it."""

    category_id: str | None = None
    clear_category: bool = False
    merchant_id: str | None = None
    notes: str | None = None
    tags: tuple | None = None
    review_state: str | None = None


def edited(ledger: DataFrame, edit: Edit) -> DataFrame:
    """``ledger`` with the edit in every row; edited classifications are locked."""
    new: dict[str, Column] = {}
    if edit.category_id is not None or edit.clear_category:
        new["category_id"] = F.lit(edit.category_id).cast("string")
        new["category_locked"] = F.lit(True)
    if edit.merchant_id is not None:
        new["merchant_id"] = F.lit(edit.merchant_id)
        new["merchant_locked"] = F.lit(True)
    if edit.notes is not None:
        new["notes"] = F.lit(edit.notes)
    if edit.tags is not None:
        new["tags"] = F.array(*[F.lit(t) for t in edit.tags]).cast("array<string>")
    if edit.review_state is not None:
        new["review_state"] = F.lit(edit.review_state)
    return ledger.withColumns(new)


def bulk_edit_plan(ledger: DataFrame, ids: DataFrame, edit: Edit) -> DataFrame:
    """txn_id, before and after of each selected row that the edit changes. A change of the merchant alone is none."""
    watched = ["category_id", "notes", "tags", "review_state"]
    chosen = ledger.join(ids.select("txn_id").distinct(), "txn_id", "left_semi")
    both = chosen.select("txn_id", F.struct(*watched).alias("before")).join(edited(chosen, edit).select("txn_id", F.struct(*watched).alias("after")), "txn_id")
    same = F.lit(True)
    for c in watched:
        same &= F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    return both.filter(~same)


def bulk_edit_preview(ledger: DataFrame, ids: DataFrame, edit: Edit) -> DataFrame:
    """selected (distinct ids), affected, unchanged and missing, in one row."""
    chosen = ids.select("txn_id").distinct()
    seen = chosen.join(ledger.select("txn_id", F.lit(True).alias("found")), "txn_id", "left")
    changed = bulk_edit_plan(ledger, ids, edit).select("txn_id", F.lit(True).alias("changed"))
    flags = seen.join(changed, "txn_id", "left")
    n = money.count_if
    return flags.agg(
        F.count("*").cast("long").alias("selected"),
        n(F.col("changed").isNotNull()).alias("affected"),
        n(F.col("found").isNotNull() & F.col("changed").isNull()).alias("unchanged"),
        n(F.col("found").isNull()).alias("missing"),
    )
