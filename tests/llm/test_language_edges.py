"""Language identification of the shortest texts, and of one text wherever it stands."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from coinbrook.llm import langid
from tests.llm import rows


def test_single_letters_have_a_language(spark):
    got = {r.doc_id: r for r in langid.identify(rows.documents(spark)).collect()}
    assert got[7003].lang_pred in ("en", "de") and got[7003].score > 0
    learn = spark.createDataFrame([("the cat and the dog", "en"), ("我 是 人", "zh")], "text string, lang string")
    texts = spark.createDataFrame([(1, "A."), (2, "我"), (3, " a "), (4, "1."), (5, ""), (6, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(texts, langid.fit(learn)).collect()}
    assert out[2].lang_pred == "zh" and all(out[i].lang_pred in ("en", "zh") and out[i].score > 0 for i in (1, 2, 3))
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (4, 5, 6))


def test_trigrams_do_not_depend_on_neighbours():
    texts = ["x", " x", "(x)", "", "12", "ab c", "\x00ab\x00c", "ab c."]
    bucket, text, any_letter = langid.trigrams(texts)
    for i, t in enumerate(texts):
        alone, _, has = langid.trigrams([t])
        assert np.array_equal(bucket[text == i], alone) and has[0] == any_letter[i]
    assert [int((text == i).sum()) for i in range(len(texts))] == [1, 1, 1, 0, 0, 3, 3, 3]


def plain_mixture(likelihood, n, rounds=langid.ROUNDS):
    """The same estimate, written out."""
    k = len(likelihood)
    share = [1 / k] * k
    for _ in range(rounds if k > 1 else 0):
        weight = [0.0] * k
        for j, times in enumerate(n):
            total = sum(share[i] * likelihood[i][j] for i in range(k))
            for i in range(k):
                weight[i] += times * share[i] * likelihood[i][j] / total
        new = [w / sum(n) for w in weight]
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-4
        share = new
        if done:
            break
    return share, sum(times * math.log(sum(share[i] * likelihood[i][j] for i in range(k))) for j, times in enumerate(n))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 6), st.randoms(use_true_random=False))
def test_mixture_by_hand(k, m, rng):
    likelihood = [[rng.random() + 0.01 for _ in range(m)] for _ in range(k)]
    n = [rng.randrange(1, 9) for _ in range(m)]
    share, value = langid.mixture(np.array(likelihood), np.array(n, float))
    expected, expected_value = plain_mixture(likelihood, n)
    assert np.allclose(share, expected) and math.isclose(value, expected_value, rel_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1 é.\x00İ", max_size=8), min_size=1, max_size=6))
def test_trigrams_do_not_depend_on_the_batch(texts):
    bucket, text, letter = langid.trigrams(texts)
    for i, t in enumerate(texts):
        alone, _, own = langid.trigrams([t])
        assert sorted(bucket[text == i].tolist()) == sorted(alone.tolist()) and letter[i] == own[0]


def test_more_languages_than_the_model_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_NUMBERS", 1 << 18)
    words = {f"l{i:02d}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}{d}" for c in "xyz" for d in "uvw") for i in range(30)}
    rows = spark.createDataFrame([(k, t, k) for k, t in words.items()], "doc_id string, text string, lang string")
    model = langid.fit(rows.select("text", "lang"))
    assert len(model.languages) == 30 and model.likelihood.size <= 1 << 18
    got = {r.lang_pred for r in langid.predict(rows.select(langid.F.lit(1).alias("doc_id"), "text"), model).collect()}
    assert got == set(words)
