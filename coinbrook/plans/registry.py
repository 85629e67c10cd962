"""Name, Spark form and SQL form of every registered query."""

from __future__ import annotations

from coinbrook.plans import cash_queries, decision_queries, lifecycle_queries, match_queries, refusal_queries, statement_queries, text_queries, workspace_queries
from coinbrook.plans.ledgers import DataFrame, SparkSession  # noqa: F401

_PARTS = (cash_queries.QUERIES, match_queries.QUERIES, text_queries.QUERIES, statement_queries.QUERIES, workspace_queries.QUERIES, lifecycle_queries.QUERIES, refusal_queries.QUERIES, decision_queries.QUERIES)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, (fn, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.items() if sql}
