"""Language identification by multilingual mixtures.

``fit`` counts hashed letter trigrams by language over every labelled row: the model is
a table of BUCKETS numbers a language, however large the input. It never has more than
MODEL_NUMBERS: with more than 256 languages, buckets are folded together until all
languages fit. ``predict`` reads a
document as a mixture: expectation-maximisation estimates the share of each language
from its trigrams' likelihoods, and the set of languages is the one with the best
penalised likelihood among the sets of the k largest shares.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go
to the language that sorts first; rows that repeat a document are predicted alike; no
labelled row at all gives ``und`` for every text; an empty table gives an empty result;
further columns are ignored. No label is left out. A text's result depends on that text
and the model alone, not on the rows beside it.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, slices

BUCKETS, MODEL_NUMBERS = 1 << 16, 1 << 24
#: Different pairs of language and bucket that a task holds before it sends their counts.
HELD = 1 << 20
ROUNDS = 25
#: A language joins the set if it lifts the log likelihood by this times the logarithm of the trigrams.
PENALTY = 3.0

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text index of every trigram, and whether each text has a letter. Texts are lower-cased; other characters than letters are one blank, and each text has a blank of its own before and after it."""
    joined = "".join(f"\x00{t.lower()} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    text = np.cumsum(points == 0) - 1
    # A literal U+0000 inside a text would shift the count.
    if text[-1] != len(texts) - 1:
        return trigrams([t.replace("\x00", " ") for t in texts])
    letter = letter_table()[points]
    any_letter = np.bincount(text[letter], minlength=len(texts)) > 0
    chars = np.where(letter, points, 0).astype(np.uint64)
    keep = letter | np.r_[True, letter[:-1]] | (points == 0)
    chars, text = chars[keep], text[keep]
    code = (chars[:-2] * np.uint64(0x9E3779B97F4A7C15) + chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) + chars[2:] * np.uint64(0xA0761D6478BD642F)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    inside = (text[:-2] == text[2:]) & (chars[1:-1] > 0)
    return (code >> np.uint64(48)).astype(np.int64)[inside], text[:-2][inside], any_letter


def training_rows(df: DataFrame) -> DataFrame:
    """text and lang of the rows to learn from: both known, and the id's CRC-32 modulo 3 not 1."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return df.filter((F.crc32(id_text.cast("binary")) % 3 != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.mask = counts.shape[1] - 1
        smooth = counts + 0.5
        self.likelihood = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float64)


def fit(rows: DataFrame) -> Model:
    """Counts all trigrams of ``rows`` (text, lang). Tasks pre-sum what they met; at most MODEL_NUMBERS sums reach the driver."""

    def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(back, np.concatenate(counts)).astype(np.int64)

    def sent(names: list[str], code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lang = pa.DictionaryArray.from_arrays(pa.array((code // BUCKETS).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array((code % BUCKETS).astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    def run(batches):
        langs: dict[str, int] = {}
        code, n = np.zeros((2, 0), np.int64)
        for batch in slices(batches):
            texts, own = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            bucket, text, _ = trigrams(texts)
            of = np.array([langs.setdefault(x, len(langs)) for x in own], np.int64)
            new, times = np.unique(of[text] * BUCKETS + bucket, return_counts=True)
            code, n = summed([code, new], [n, times])
            if len(code) > HELD:
                yield sent(list(langs), code, n)
                langs, (code, n) = {}, np.zeros((2, 0), np.int64)
        if len(code):
            yield sent(list(langs), code, n)

    counted = cut(arrow_step(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    n_languages = max(1, counted.agg(F.countDistinct("lang")).first()[0])
    size = BUCKETS
    while size > 1 and size * n_languages > MODEL_NUMBERS:
        size //= 2
    got = counted.groupBy("lang", F.col("bucket").bitwiseAND(size - 1).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(languages), size))
    at = {x: i for i, x in enumerate(languages)}
    counts[[at[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts)


def mixture(likelihood: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of ``likelihood``) and the log likelihood, for trigrams that occur ``n`` times."""
    share = np.full(len(likelihood), 1 / len(likelihood))
    for _ in range(rounds if len(likelihood) > 1 else 0):
        joint = share[:, None] * likelihood
        new = (joint / joint.sum(axis=0)) @ n / n.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(np.log(share @ likelihood) @ n)


def language_set(likelihood: np.ndarray, n: np.ndarray) -> dict[int, float]:
    """Languages of one document with their shares."""
    share, _ = mixture(likelihood, n)
    order = np.argsort(-share, kind="stable")
    best, cost = {}, math.inf
    for k in range(1, len(order) + 1):
        some = order[:k]
        part, log_likelihood = mixture(likelihood[some], n)
        penalised = -log_likelihood + PENALTY * (k - 1) * math.log(n.sum() + 1)
        if penalised >= cost:
            break
        best, cost = {int(i): float(p) for i, p in zip(some, part, strict=True)}, penalised
    return best


def predict(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its share) and languages (the set, by falling share), a row for each row of ``df``; only texts are read for it."""
    kind = "doc_id long, lang_pred string, score double, languages string"
    names = [x.split()[0] for x in kind.split(", ")]
    sent = df.sparkSession.sparkContext.broadcast(model)  # MODEL_NUMBERS numbers at most

    def run(batches):
        m = sent.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bucket, text, any_letter = trigrams(texts)
            edge = np.searchsorted(text, np.arange(len(texts) + 1))
            rows = []
            for i in range(len(texts)):
                b = bucket[edge[i] : edge[i + 1]]
                if not any_letter[i] or not m.languages:
                    rows.append(("und", 0.0, ""))
                    continue
                b, n = np.unique(b & m.mask, return_counts=True)
                found = language_set(m.likelihood[:, b], n.astype(np.float64))
                order = sorted(found, key=lambda k: (-found[k], m.languages[k]))
                rows.append((m.languages[order[0]], min(1.0, found[order[0]]), ",".join(m.languages[k] for k in order)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.string()), strict=True))], names=names)

    return arrow_step(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, kind)


def identify(df: DataFrame) -> DataFrame:
    """Fits on the training rows of ``df`` and predicts all its rows; held_out marks those kept from training by their id."""
    out = predict(df, fit(training_rows(df)))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
