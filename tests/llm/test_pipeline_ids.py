"""The decontamination stage tells rows of one id, and rows without one, apart by their text."""

from collections import Counter

import corpus_pipeline
from tests.llm import rows


def test_clean_rows_of_a_leaking_id_stay(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    clean = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    leak = clean[0] + " " + item
    own = [(None, leak), (None, clean[0]), (None, clean[1]), (1, leak), (1, clean[1]), (1, leak), (2, clean[2]), (2, clean[2]), (None, None), (3, leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in own], rows.DOC_SCHEMA)
    got = corpus_pipeline.decontamination(spark, docs, sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t in own if t != leak)
