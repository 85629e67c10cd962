"""The orders that users see. Ids are compared as text; names by Unicode collation. Ask for a page (``limit``) of them: Spark then keeps only a page's rows of each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _id(name: str) -> Column:
    return F.col(name).cast("string")


def review_queue(queue: DataFrame) -> DataFrame:
    """Newest first, then by id."""
    return queue.orderBy(F.desc("posted_date"), _id("txn_id"))


def duplicates(found: DataFrame) -> DataFrame:
    """Best score first, then by both ids."""
    return found.orderBy(F.desc("score"), _id("existing_id"), _id("incoming_id"))


def transfers(found: DataFrame) -> DataFrame:
    """Best score first, then by the pair's signature."""
    return found.orderBy(F.desc("score"), "signature")


def recurring(found: DataFrame, score: str = "confidence") -> DataFrame:
    """Surest first, then by signature."""
    return found.orderBy(F.desc(score), F.collate("signature", "UNICODE"))


def merchants(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.collate("name", "UNICODE"))


def categories(rows: DataFrame) -> DataFrame:
    return rows.orderBy("position", F.collate("name", "UNICODE"))


def rules(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("priority"), F.collate("name", "UNICODE"))


def history(rows: DataFrame) -> DataFrame:
    """Newest edit first, the later id first among equals."""
    return rows.orderBy(F.desc("occurred_at"), F.desc("event_id"))
