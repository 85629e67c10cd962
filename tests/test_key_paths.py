"""Key paths of documents: each is made and parsed once, and equals a plain walk."""

import json
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from coinbrook.operators import documents


def walked(value, path="", depth=1):
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}/{k}", k, depth
            yield from walked(v, f"{path}/{k}", depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from walked(v, f"{path}[]", depth + 1)


def test_documents_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def body(i):
        made.add(1)
        return json.dumps({"a": {"b": [{"c": i}]}, "d": i})

    docs = spark.range(12).select("id", F.udf(body, "string")("id").alias("j"))
    assert len(documents.key_paths(docs, "id", "j").collect()) == 48 and made.value == 24  # once for the brackets
    assert len(documents.key_paths(docs, "id", "j", 4).collect()) == 48 and made.value == 36


def test_equal_to_a_walk(spark):
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.randrange(8 if depth else 3)
        return [None, rnd.randrange(9), "{[["][kind] if kind < 3 else [value(depth - 1) for _ in range(rnd.randrange(4))] if kind < 5 else {rnd.choice(["x", "ä", "/", "[]"]) + str(i): value(depth - 1) for i in range(rnd.randrange(4))}

    many = [value(5) for _ in range(80)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(many)] + [(-i, j) for i, j in enumerate([None, "", "{}}", '{"a":1} {"b":2}', '{"a":1,"a":2}', '1] [{"a":1}', '1,{"a":1}', '{"a":1}]'], 1)], "i int, j string")
    want = sorted((i, *p) for i, v in enumerate(many) for p in walked(v))
    assert len(want) > 200 and sorted(map(tuple, documents.key_paths(df, "i", "j").collect())) == want


def test_more_levels_than_said(spark):
    df = spark.createDataFrame([(1, '{"a":{},"b":[],"c":{"d":1}}')], "i int, j string")
    paths = lambda n: sorted(r.path for r in documents.key_paths(df, "i", "j", n).collect())
    assert paths(2) == paths(9) == paths(None) == ["/a", "/b", "/c", "/c/d"]
    with pytest.raises(SparkRuntimeException, match="more than 1 levels: /c"):
        paths(1)


def test_levels_of_a_transaction(spark):
    ledger = spark.createDataFrame([("t", "{[", "1.50", ["[[[[["], "c", "m")], "txn_id string, description string, amount string, tags array<string>, category_id string, merchant_id string")
    docs = documents.transaction_documents(ledger.withColumn("amount", F.col("amount").cast("decimal(18,2)")))
    known = documents.key_paths(docs, "txn_id", "document", documents.LEVELS).collect()
    assert sorted(known) == sorted(documents.key_paths(docs, "txn_id", "document").collect()) and max(r.depth for r in known) == documents.LEVELS
