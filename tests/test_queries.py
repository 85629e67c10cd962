"""Every query with an SQL form against DuckDB on the smallest tables."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from coinbrook.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    rel = duck.sql(registry.oracle_sql()[name])
    ours = registry.queries()[name](spark, sf)
    assert sorted(ours.columns) == sorted(rel.columns)
    assert Counter(map(rounded, ours.select(*rel.columns).collect())) == Counter(map(rounded, rel.fetchall()))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())
