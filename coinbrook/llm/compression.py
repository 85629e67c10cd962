"""A quality classifier by compression.

``fit`` trains one zstandard dictionary on good and one on bad labelled text, and calibrates
on other labelled documents. ``score`` compresses every piece of every text with both: the
dictionary that knows a text better makes it smaller. The difference of the two sizes, over
their sum, and the size a byte, which tells repetitive text apart that both make tiny, go
through a logistic calibration to a score between 0 and 1.

Learning reads a bounded sample: of each class the SAMPLE_ROWS documents with the least hash
of their id (half for dictionaries, half for calibration) and of the former the SAMPLE_PIECES
pieces with the least hash. Weights give each class its share among all labels. Everything
else covers whole texts: pieces are PIECE bytes, and none is left out.

Defined results: a null text is empty; an empty text has a score like any other; labels that
are neither 0 nor 1, have no id, or contradict each other for an id are not learned from; of
several texts under a labelled id the least is; without labels of both classes every score is
the share of label 1 among labels (1/2 without any); equal texts get equal scores; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, documents, slices

PIECE, LEVEL, DICTIONARY_BYTES = 1024, 3, 1 << 16
SAMPLE_ROWS, SAMPLE_PIECES = 4000, 6400
#: A score from here on counts as label 1.
THRESHOLD = 0.3
#: Strength of the calibration's pull towards no effect, in labelled rows.
RIDGE = 0.1


@dataclass(frozen=True)
class Model:
    """Dictionaries of the two classes, and weights of the calibration; without dictionaries every score is ``prior``."""

    prior: float
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()


def remainder() -> Column:
    """The id's CRC-32 modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label (0 or 1) to learn from, a row an id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder() != 0))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")


def pieces(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on ``samples``; where they are too few or too alike to train on, their end."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(data)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def features(sizes: np.ndarray) -> np.ndarray:
    """Of rows (good size, bad size, bytes): 1, the normalised difference, the logarithm of the size a byte, and its square."""
    good, bad, n = sizes.T.astype(np.float64)
    ratio = np.log(np.maximum(good + bad, 1) / 2 / np.maximum(n, 1)).clip(-6, 1)
    return np.stack([np.ones(len(n)), 10 * (bad - good) / np.maximum(good + bad, 1), ratio, ratio * ratio], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton's method with halved steps where one goes too far."""
    pull = np.r_[0.0, np.full(x.shape[1] - 1, RIDGE)] + 1e-6

    def loss(w):
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + pull @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 0.5 + np.tanh(x @ w / 2) / 2
        slope = x.T @ (weight * (p - y)) + pull * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(pull), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sizes(df: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``df``'s columns but text, and the sizes of each whole text: under both dictionaries and as it is."""
    keep = [f for f in df.schema.fields if f.name != "text"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", good long, bad long, n_bytes long"
    # Two dictionaries of DICTIONARY_BYTES at most.
    sent = df.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches):
        both = [compressor(x) for x in sent.value]
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                own = pieces(text)
                rows.append([*(sum(len(c.compress(p)) for p in own) for c in both), sum(map(len, own))])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=[x.split()[0] for x in kind.split(", ")])

    return arrow_step(df, run, kind)


def _samples(rows: DataFrame) -> dict[int, list[bytes]]:
    """Pieces of each class to train on; at most SAMPLE_PIECES of PIECE bytes a class reach the driver."""

    def run(batches):
        for batch in slices(batches):
            out = [(label, xxhash.xxh3_64_intdigest(p) >> 1, p) for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in pieces(text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["label", "h", "piece"])

    cut_up = arrow_step(rows.select("label", "text"), run, "label int, h long, piece binary")
    return {label: [r["piece"] for r in cut_up.filter(F.col("label") == label).orderBy("h", "piece").limit(SAMPLE_PIECES).collect()] for label in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = cut(training_labels(labels))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = count.get(1, 0) / sum(count.values()) if count else 0.5
    by_hash = lambda label: known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # Two times SAMPLE_ROWS ids: small enough to send to every task.
    some = F.broadcast(by_hash(0).unionByName(by_hash(1)))
    rows = cut(documents(docs).join(some, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    samples = _samples(rows.filter(half == 0))
    if not all(samples.values()):
        return Model(prior)
    good, bad = dictionary(samples[1]), dictionary(samples[0])
    got = sizes(rows.filter(half == 1).select("label", "text"), good, bad).toArrow()
    y = got.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(prior)
    x = features(np.stack([got.column(c).to_numpy() for c in ("good", "bad", "n_bytes")], axis=1))
    share = {label: count[label] / sum(count.values()) * len(y) / (y == label).sum() for label in (0, 1)}
    return Model(prior, good, bad, tuple(logistic(x, y, np.where(y == 1, share[1], share[0])).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of ``docs``; only texts are read for the score."""
    rows = documents(docs)
    if model.good and model.bad:
        got = sizes(rows, model.good, model.bad)
        total = F.greatest(F.col("good") + F.col("bad"), F.lit(1)).cast("double")
        ratio = F.greatest(F.lit(-6.0), F.least(F.lit(1.0), F.log(total / 2 / F.greatest(F.col("n_bytes"), F.lit(1)))))
        w = [F.lit(float(x)) for x in model.weights]
        z = w[0] + w[1] * 10 * (F.col("bad") - F.col("good")) / total + w[2] * ratio + w[3] * ratio * ratio
        rows = got.withColumn("score", 1 / (1 + F.exp(-z)))
    else:
        rows = rows.withColumn("score", F.lit(float(model.prior)))
    return rows.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels whose id is not held out, and scores all of ``docs``."""
    return score(docs, fit(docs, labels))
