"""The compression classifier: held-out accuracy, scores by hand, and odd rows."""

import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from coinbrook.llm import compression
from tests.llm.rows import documents, empty

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0, "clash", 1.0) for i, q in rows], LABELS)


@pytest.fixture(scope="module")
def scored(spark):
    """The second table: a few hundred labels."""
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = compression.fit(docs, known)
    return docs, known, model, compression.score(docs, model).cache()


def test_held_out_accuracy(scored):
    docs, known, _, got = scored
    rows = got.join(known, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) >= 0.95 and np.mean([r.predicted for r in bad]) <= 0.35
    # A random good document outscores a random bad one nearly always.
    assert np.mean([[a.score > b.score for b in bad] for a in good]) >= 0.95
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_scores_by_hand(scored):
    docs, _, model, got = scored
    score = {r.doc_id: r for r in got.collect()}
    both = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in docs.limit(60).collect():
        data = r.text.encode()
        good, bad = (sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for c in both)
        ratio = min(1, max(-6, math.log(max(good + bad, 1) / 2 / max(len(data), 1))))
        z = float(np.dot(model.weights, [1, 10 * (bad - good) / max(good + bad, 1), ratio, ratio**2]))
        assert score[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert score[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_are_not_read(spark, scored):
    docs, known, model, _ = scored
    turned = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.fit(docs, turned) == model


def test_logistic_finds_the_minimum():
    rnd = np.random.default_rng(3)
    x = np.c_[np.ones(200), rnd.normal(size=(200, 2))]
    y, weight = (rnd.random(200) < 1 / (1 + np.exp(-x @ [0.5, 2, -1]))).astype(float), rnd.random(200) + 0.5
    w = compression.logistic(x, y, weight)
    slope = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + np.r_[0, compression.RIDGE, compression.RIDGE] * w
    assert np.abs(slope).max() < 1e-3
    apart = compression.logistic(np.c_[np.ones(40), np.r_[np.full(20, -1.0), np.ones(20)]], np.r_[np.zeros(20), np.ones(20)], np.ones(40))
    assert np.isfinite(apart).all() and apart[1] > 1


def test_odd_rows(spark, sf):
    docs = documents(spark, sf)
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()
    odd = labels(spark, [*map(tuple, known), (None, 1), (7003, None), (7004, 0), (7004, 0), (7006, 1), (7006, 0), (7007, 2)])
    got = compression.classify(docs, odd)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.filter("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert got.filter("doc_id = 7003").distinct().count() == 1 and got.filter("doc_id is null and held_out").count() == 2
    assert {r.label for r in compression.training_labels(odd).filter("doc_id in (7004, 7006, 7007)").collect()} <= {0}


@pytest.mark.parametrize("rows, prior", [([], 0.5), ([(7004, 1), (7002, 1), (7003, 1), (7005, 1), (7001, 1)], 1.0)])
def test_labels_of_one_class_or_none(spark, rows, prior):
    got = compression.classify(documents(spark), labels(spark, rows))
    assert {r.score for r in got.collect()} == {prior}


def test_empty_table(spark):
    assert compression.classify(empty(spark), labels(spark, [(1, 1), (2, 0), (3, 1), (4, 0)])).count() == 0
