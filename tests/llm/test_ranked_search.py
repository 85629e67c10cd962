"""Ranked search against brute force: every document scored for every item."""

import random
from collections import Counter, defaultdict

import pytest

from coinbrook.llm import ranked
from tests.llm.rows import documents, empty, pairs


def brute(rows, items, k=10):
    docs = [(i, Counter(ranked.terms_of(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in items:
        best = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(ranked.weight(n_docs, df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ranked.terms_of(text) if t in c)
            if score > 0:
                best.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(best)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


def answer(spark, rows, items, k=10):
    got = ranked.search(ranked.build(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), k)
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shard, width, block", [(40, 1, 3), (7, 32, 100), (1 << 20, 4, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, width, block):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked, "WIDTH", width)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", block)
    rnd = random.Random(shard)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éa", "ÉA", "x1", "日本"]
    text = lambda n: " ".join(rnd.choices(vocabulary, weights=range(1, 35), k=rnd.randrange(n)))
    rows = [(rnd.choice([None, *range(-30, 300)]), text(25)) for _ in range(220)] + [(5, None), (6, ""), (7, "..."), (8, "w3 " * 3000), (9, "tie tie"), (2, "tie tie"), (2, "tie tie")]
    items = [(i, text(9)) for i in range(7)] + [(7, "tie w1 w1"), (7, "tie w1 w1"), (8, None), (9, ""), (None, "w2 W2 éa Éa"), (10, "absent")]
    assert answer(spark, rows, items) == brute(rows, items)


def test_many_ties_go_by_id(spark):
    rows = [(i, "same words here" if i % 2 else "other words there") for i in range(60, 0, -1)]
    got = answer(spark, rows, [(1, "here"), (2, "words")])
    assert got == brute(rows, [(1, "here"), (2, "words")])
    by_item = defaultdict(list)
    for item, rank, doc, _ in sorted(got):
        by_item[item].append(doc)
    assert by_item[1] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]


def test_odd_rows_and_empty_tables(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "all rights reserved words", "clash"), (2, None, "clash")], "item_id long, text string, score string")
    got = Counter(tuple(r) for r in ranked.search(ranked.build(docs), items).collect())
    assert got == brute(pairs(docs), [(1, "all rights reserved words"), (2, None)]) and got
    assert ranked.search(ranked.build(empty(spark)), items).count() == 0
    none = ranked.search(ranked.build(docs), items.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
