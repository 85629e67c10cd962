"""Benchmark decontamination with SimHash over item-sized windows.

1. Each benchmark item becomes its shingles (five words, each as often as it occurs), a
   128-bit SimHash and a content hash; items of equal content are compared once.
2. For each size of an item, windows of as many words slide over every text. A window
   that can reach the threshold must hold most of its shingles among those of items of
   that size, so a Bloom filter of the items' shingles (at most FILTER_BITS bits, however
   large the benchmark; no false negatives) and running sums pick the windows that are
   fingerprinted. A filter that is too full picks more windows, never fewer.
3. Windows of equal content are gathered, so that a passage in a third of all texts is
   compared once. Fingerprints are cut into BLOCKS blocks; two at most RADIUS apart differ
   by at most RADIUS // BLOCKS bits in some block. Windows' blocks are hash-joined to all
   values that near the items' blocks: no fingerprint within RADIUS is lost. A pair is
   taken at its first such block.
4. Candidates within RADIUS are verified by exact weighted Jaccard similarity of their
   shingles (weights: occurrences), then joined back to all windows of that content.

Only the radius can lose a match: about one pair in 400 at a similarity of exactly 0.8.
Nothing of the benchmark passes the driver but its sizes and the filter.

Defined results: a null text or item has no words and matches nothing; a text shorter
than an item is one window; fewer than five words are one shingle; equal items each
match; rows that repeat a doc_id give one row for each item, the best; ties go to the
earliest window. Empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, documents, slices
from coinbrook.llm.shingles import WORDS_IN_SHINGLE, shingle_hashes, word_hashes, words

THRESHOLD = 0.8
#: At similarity 0.8 two fingerprints differ by 19.5 bits on average, with a deviation of 4.1.
RADIUS, BLOCKS = 31, 16
BITS_IN_BLOCK = 128 // BLOCKS
#: The filter has 64 bits for each shingle of an item, up to this many in all (16 MB).
FILTER_BITS = 1 << 27
#: Stands for all sizes in the filter.
ANY_SIZE = 0


def fingerprint(shingles: np.ndarray) -> bytes:
    """128-bit SimHash of shingles, each counted as often as it occurs."""
    second = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    both = np.stack([shingles * np.uint64(0x94D049BB133111EB), second ^ (second >> np.uint64(27))], 1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(shingles), 16), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)).tobytes()


def near_values(value: int, radius: int = RADIUS // BLOCKS) -> list[int]:
    """All block values at most ``radius`` bits from ``value``."""
    out = {value}
    for _ in range(radius):
        out |= {v ^ (1 << b) for v in out for b in range(BITS_IN_BLOCK)}
    return sorted(out)


def least_shared(n_window: int, n_item: int) -> int:
    """Shingles that a window and an item must share for the threshold."""
    return max(1, math.ceil(THRESHOLD * (n_window + n_item) / (1 + THRESHOLD) - 1e-9))


def content(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a window's or an item's shingles in their order."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist())


def text_hash():
    """Hash of the column ``text``, null as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _batch(rows: list[tuple], names: str, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in names.split(", ")])


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words), i1 and i2 (content), item_fp and item_shingles of each different item that has words."""
    kind = "item_id long, size int, i1 long, i2 long, item_fp binary, item_shingles binary"

    def run(batches):
        memo: dict[str, int] = {}
        for batch in slices(batches):
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = words(text)
                if tokens:
                    s = shingle_hashes(word_hashes(tokens, memo))
                    rows.append((item_id, len(tokens), *content(s), fingerprint(s), s.tobytes()))
            if rows:
                yield _batch(rows, kind, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return arrow_step(items.distinct(), run, kind)


def _slots(shingles: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``bits`` bits (a power of two) for each shingle of items of ``size`` words."""
    h = (shingles ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    top = np.uint64(64 - (bits.bit_length() - 1))
    return h >> top, (h * np.uint64(0xD6E8FEB86659FD93)) >> top


class Filter:
    """Bloom filter of the items' shingles by size, and the sizes."""

    def __init__(self, sizes: list[int], bits: int, held: np.ndarray):
        self.sizes, self.bits, self.held = sizes, bits, held

    def has(self, shingles: np.ndarray, size: int) -> np.ndarray:
        out = np.ones(len(shingles), bool)
        for at in _slots(shingles, size, self.bits):
            out &= (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def item_filter(items: DataFrame, most: int = FILTER_BITS) -> Filter:
    """The filter of ``item_table``'s rows; bits are gathered by word on the executors, and only the filter itself comes to the driver."""
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # of n words in all, the square root of 2n at most
    total = items.agg(F.sum(F.octet_length("item_shingles") / 8)).first()[0] or 0
    bits = min(most, 1 << max(16, math.ceil(math.log2(64 * total + 1))))

    def run(batches):
        for batch in batches:
            found = []
            for size, data in zip(batch.column("size").to_pylist(), batch.column("item_shingles").to_pylist(), strict=True):
                for s in (size, ANY_SIZE):
                    found += _slots(np.frombuffer(data, np.uint64), s, bits)
            if found:
                at = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    got = arrow_step(items.select("size", "item_shingles"), run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return Filter(sizes, bits, held.view(np.uint8))


_KEY = ["size", "w1", "w2"]


def windows(df: DataFrame, known: Filter) -> DataFrame:
    """doc_id, dh (of the text), start, n_words, size (of the items meant), content (w1, w2), fp and shingles of every window that can reach the threshold."""
    kind = "doc_id long, dh long, start long, n_words long, size int, w1 long, w2 long, fp binary, shingles binary"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    sent = df.sparkSession.sparkContext.broadcast(known)  # FILTER_BITS bits at most

    def starts(hit: np.ndarray, n: int, need: int) -> list[int]:
        total = np.r_[0, np.cumsum(hit)]
        return np.flatnonzero(total[n:] - total[:-n] >= need).tolist()

    def run(batches):
        items, memo = sent.value, {}
        for batch in slices(batches):
            rows = []
            for doc_id, dh, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "dh", "text")), strict=True):
                tokens = words(text)
                if not tokens:
                    continue
                hashes = word_hashes(tokens, memo)
                whole = shingle_hashes(hashes)
                maybe = np.flatnonzero(items.has(whole, ANY_SIZE))
                for size in items.sizes:
                    k = min(WORDS_IN_SHINGLE, size)
                    short = k < WORDS_IN_SHINGLE and len(tokens) > k
                    shingles = shingle_hashes(hashes, k) if short else whole
                    n_item, n = size - k + 1, min(size - k + 1, len(shingles))
                    need = least_shared(n, n_item)
                    if need > n or (not short and len(maybe) < need):
                        continue
                    if short:
                        hit = items.has(shingles, size)
                    else:
                        hit = np.zeros(len(shingles), bool)
                        hit[maybe] = items.has(shingles[maybe], size)
                    if np.count_nonzero(hit) < need:
                        continue
                    for start in starts(hit, n, need):
                        s = shingles[start : start + n]
                        rows.append((doc_id, dh, start, n + k - 1, size, *content(s), fingerprint(s), s.tobytes()))
                    if len(rows) > 5_000:
                        yield _batch(rows, kind, types)
                        rows = []
            if rows:
                yield _batch(rows, kind, types)

    return arrow_step(documents(df, text_hash().alias("dh")), run, kind)


def _block(fp: str, k):
    """Block ``k`` (from 0) of a fingerprint column."""
    return F.conv(F.hex(F.substring(F.col(fp), k + 1, F.lit(1))), 16, 10).cast("int")


def _distance(a: str, b: str):
    """Bits in which two fingerprints differ."""
    half = lambda c, at: F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("long")
    return sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (5, 9, 13)), F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))))


def candidates(contents: DataFrame, items: DataFrame) -> DataFrame:
    """size, w1, w2, i1 and i2 of the different windows and items whose fingerprints are at most RADIUS apart, each pair once."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    near_by = F.explode(F.array(*[_block("item_fp", F.col("block")).bitwiseXOR(F.lit(x)) for x in near_values(0)])).alias("value")
    table = items.select("size", "i1", "i2", "item_fp").dropDuplicates(["size", "i1", "i2"]).select("*", blocks).select("*", near_by)
    each = contents.select(*_KEY, "fp", blocks).withColumn("value", _block("fp", F.col("block")))
    near = lambda k: F.bit_count(_block("fp", k).bitwiseXOR(_block("item_fp", k))) <= RADIUS // BLOCKS
    earlier = F.exists(F.sequence(F.lit(0), F.col("block")), lambda k: (k < F.col("block")) & near(k))
    return each.join(table, ["size", "block", "value"]).filter(~earlier).filter(_distance("fp", "item_fp") <= RADIUS).select(*_KEY, "i1", "i2")


def verify(found: DataFrame) -> DataFrame:
    """size, w1, w2, i1, i2 and similarity of the pairs (shingles, item_shingles) that hold the threshold."""
    kind = "size int, w1 long, w2 long, i1 long, i2 long, similarity double"

    def run(batches):
        for batch in batches:
            rows = []
            for *key, shingles, item in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "i1", "i2", "shingles", "item_shingles")), strict=True):
                have, own = (Counter(np.frombuffer(x, np.int64).tolist()) for x in (shingles, item))
                shared = (have & own).total()
                similarity = shared / (have.total() + own.total() - shared)
                if similarity >= THRESHOLD:
                    rows.append((*key, similarity))
            if rows:
                yield _batch(rows, kind, (pa.int32(), *[pa.int64()] * 4, pa.float64()))

    return arrow_step(found.select(*_KEY, "i1", "i2", "shingles", "item_shingles"), run, kind)


def verified(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, dh, item_id, similarity, start and n_words of every window at THRESHOLD or more."""
    items = cut(item_table(benchmark))
    known = item_filter(items)
    found = cut(windows(df, known))
    # Equal windows once: the hot passages go before anything is shuffled by their blocks.
    contents = cut(found.groupBy(*_KEY).agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles")))
    pairs = cut(candidates(contents, items))
    own = items.dropDuplicates(["size", "i1", "i2"]).select("i1", "i2", "size", "item_shingles")
    hits = verify(pairs.join(contents.select(*_KEY, "shingles"), _KEY).join(own, ["size", "i1", "i2"]))
    hits = cut(hits.join(items.select("item_id", "size", "i1", "i2").distinct(), ["size", "i1", "i2"]).select(*_KEY, "item_id", "similarity"))
    return found.select("doc_id", "dh", "start", "n_words", *_KEY).join(hits, _KEY).select("doc_id", "dh", "item_id", "similarity", "start", "n_words")


def contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start and n_words (words of the text): the best window of each text and item at THRESHOLD or more."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b")
    return verified(df, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.n_words")


def leaking_texts(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and dh (``text_hash``) of the texts that hold an item, each once: of rows that share an id, only those with such a text."""
    return verified(df, benchmark).select("doc_id", "dh").distinct()
