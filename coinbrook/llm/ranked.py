"""Ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

``build`` turns documents into an index: a row a shard. A shard holds the postings of all
its terms in one sequence, each term's postings by falling impact, and a wavelet matrix
over the (local) document numbers of that sequence, which are in the order of doc_id.
Going down the matrix keeps the order by impact, so the first posting of a term's range in
a node has the greatest impact of the term among the node's documents: the sum of these,
weighted, bounds every score below the node. ``search`` takes nodes best bound first, for
all terms of an item at once; leaves come out in their final order, so that the first
``k`` leaves are the exact answer of the shard, and a bound reached by an earlier shard of
the task ends the search sooner. Answers of shards meet in one top-k by item.

The query set is read in blocks of BLOCK_ITEMS items (BLOCK_TERMS terms, if fewer items
have that many): what is sent to tasks or to the driver at once is bounded by a block,
whatever the input; all blocks run against all shards.

Scores are 64-bit integers. A term's weight w is floor(1000 ln((2N+2)/(2df+1))); a posting's
impact is (10^9 tf) div (1000 tf + 8 m), where m is 25 + (75 n N) div L.

Defined results: a null text has no term and counts neither in N nor in L; an item that is
null or shares no term with any document has no row; equal scores go by ascending doc_id,
unknown ids last; rows that repeat a document are documents of their own, as are items that
repeat; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, shared_dir, slices

#: A shard is closed once it holds so many postings; a document is never split.
SHARD_POSTINGS = 1 << 20
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 18
TOP = 10
#: Nodes opened in one step.
WIDTH = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: How an unknown doc_id sorts: last.
NO_ID = (1 << 63) - 1

#: All columns of a shard are packed: numbers as little-endian bytes, bits eight a byte, terms joined by a line feed, which no term holds.
_SHARD = "doc_ids binary, known binary, terms binary, starts binary, impacts binary, bits array<binary>"


@dataclass(frozen=True)
class Index:
    """Shards and N, the number of documents with a term."""

    shards: DataFrame
    n_docs: int


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8: bytes above 127 are never part of a separator, and only A-Z change case."""
    return _TERM_BYTES.findall((text or "").encode().lower())


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all terms. Two sums, counted in the JVM."""
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TERM)).cast("long")
    got = docs.select(n.alias("n")).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("docs"), F.sum("n").alias("terms")).first()
    return got["docs"] or 0, got["terms"] or 0


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 25 + (75 * length * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def wavelet(numbers: np.ndarray, size: int) -> list[np.ndarray]:
    """Bits of each level of a wavelet matrix over ``numbers`` below ``size``, highest bit first; every partition is stable."""
    levels, seq = [], numbers
    for bit in reversed(range(max(1, (size - 1).bit_length()))):
        one = (seq >> bit) & 1 == 1
        levels.append(one)
        seq = np.concatenate([seq[~one], seq[one]])
    return levels


class _Open:
    """A shard being filled: document, term and frequency of each posting."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.term, self.tf, self.per_doc = [], [], []
        self.n = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms_of(text)
        if not found:
            return
        counts = Counter(found)
        names = self.names
        self.term.append(np.fromiter((names.setdefault(t, len(names)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.per_doc.append(len(counts))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.n += len(counts)

    def closed(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        known = np.array([x is not None for x in self.ids])
        by_id = np.lexsort((~known, ids))
        number = np.empty(len(ids), np.int32)
        number[by_id] = np.arange(len(ids), dtype=np.int32)
        of = np.repeat(np.arange(len(ids)), self.per_doc)
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        names = sorted(self.names)
        place = np.empty(len(names), np.int32)
        place[[self.names[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        term, doc = place[term], number[of]
        got = impact(tf, np.array(self.lengths, np.int64)[of], n_docs, n_terms).astype(np.int32)
        order = np.lexsort((doc, -got, term))
        starts = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
        bits = [np.packbits(x).tobytes() for x in wavelet(doc[order], len(ids))]
        packed = (ids[by_id].tobytes(), np.packbits(known[by_id]).tobytes(), b"\n".join(names), starts.tobytes(), got[order].tobytes())
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in packed), pa.array([bits], pa.list_(pa.binary()))], names=[x.split()[0] for x in _SHARD.split(", ")])


def build(docs: DataFrame) -> Index:
    """The index of ``docs``, written to the shared folder: a row a shard. Documents are read where they lie; nothing is shuffled."""
    n_docs, n_terms = totals(docs)

    def run(batches):
        shard = _Open()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.n >= SHARD_POSTINGS:
                    yield shard.closed(n_docs, n_terms)
                    shard = _Open()
        if shard.n:
            yield shard.closed(n_docs, n_terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    # A row is some megabytes: row groups close by size, not after a hundred rows.
    arrow_step(rows, run, _SHARD).write.option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 1).parquet(path)
    return Index(docs.sparkSession.read.schema(_SHARD).parquet(path), n_docs)


class Shard:
    """A shard opened for search, with the rank of every level's bits and the impacts in every level's order."""

    def __init__(self, row: dict):
        self.ids, n = np.frombuffer(row["doc_ids"], np.int64), len(row["impacts"]) // 4
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(self.ids)).astype(bool)
        self.starts, self.depth = np.frombuffer(row["starts"], np.int32), len(row["bits"])
        self.n, own = n, np.frombuffer(row["impacts"], np.int32)
        ones, zeros, impacts = np.zeros((self.depth, n + 1), np.int32), [], np.empty((self.depth + 1, n), np.int32)
        impacts[0] = own
        for level, packed in enumerate(row["bits"]):
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
            np.cumsum(one, out=ones[level, 1:])
            zeros.append(n - int(ones[level, -1]))
            impacts[level + 1] = np.concatenate([impacts[level][~one], impacts[level][one]])
        # Level by level in one array: nodes of several levels are opened by one look-up.
        self.ones, self.zeros, self.impacts = ones.ravel(), np.array(zeros), impacts.ravel()

    def best(self, at: np.ndarray, w: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, document number) above 0 and not below ``least``, best first, ties by number, for terms ``at`` of weight ``w``."""
        lo, hi = self.starts[at], self.starts[at + 1]
        bound = int(self.impacts[lo] @ w) if len(at) else 0
        # By bound, then by first document: a node that starts later holds no smaller number, so leaves leave in their final order.
        queue = [(-bound, 0, 0, lo, hi)] if bound > 0 and bound >= least else []
        out: list[tuple[int, int]] = []
        while queue and len(out) < k:
            if queue[0][2] == self.depth:
                score, number, *_ = heapq.heappop(queue)
                out.append((-score, number))
                continue
            # Several nodes are opened at once; that some need not have been changes nothing.
            some = []
            while queue and len(some) < WIDTH and queue[0][2] < self.depth:
                some.append(heapq.heappop(queue))
            self._open(some, w, least, queue)
        return out

    def _open(self, some: list, w: np.ndarray, least: int, queue: list) -> None:
        first, level = np.array([x[1] for x in some]), np.array([x[2] for x in some])
        lo, hi = np.array([x[3] for x in some]), np.array([x[4] for x in some])
        here = level[:, None] * (self.n + 1)
        one_lo, one_hi, zeros = self.ones[here + lo], self.ones[here + hi], self.zeros[level][:, None]
        a, b = np.concatenate([lo - one_lo, zeros + one_lo]), np.concatenate([hi - one_hi, zeros + one_hi])
        first, level = np.concatenate([first, first + (1 << (self.depth - level - 1))]), np.concatenate([level, level]) + 1
        # The first posting of a range has its greatest impact; an empty range has none.
        most = self.impacts[level[:, None] * self.n + np.minimum(a, self.n - 1)]
        bounds = np.where(b > a, most, 0) @ w
        for i in np.flatnonzero((bounds > 0) & (bounds >= least)).tolist():
            # No two nodes in the queue have the same start: arrays are never compared.
            heapq.heappush(queue, (-int(bounds[i]), int(first[i]), int(level[i]), a[i], b[i]))


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """item_id and counted terms of all items, in blocks of bounded size; a partition of items at a time is on the driver."""
    held, n = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if held and (len(held) >= BLOCK_ITEMS or n + len(counts) > BLOCK_TERMS):
            yield held
            held, n = [], 0
        held.append((row["item_id"], counts))
        n += len(counts)
    if held:
        yield held


def frequencies(index: Index, terms: list[bytes]) -> np.ndarray:
    """Documents that hold each of ``terms``."""
    spark = index.shards.sparkSession
    sent = spark.sparkContext.broadcast(terms)  # a block's at most

    def run(batches):
        wanted = pa.array(sent.value, pa.binary())
        for batch in batches:
            for row in batch.to_pylist():
                at = pc.index_in(wanted, value_set=pa.array(row["terms"].split(b"\n"), pa.binary()))
                i = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                n = np.diff(np.frombuffer(row["starts"], np.int32))[at.drop_null().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64())], names=["i", "n"])

    got = arrow_step(index.shards.select("terms", "starts"), run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    out = np.zeros(len(terms), np.int64)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answers(index: Index, block: list[tuple[int | None, Counter]], first: int, k: int) -> DataFrame:
    """Each shard's best documents for each item of a block; items are numbered from ``first``."""
    terms = sorted(set().union(*(c for _, c in block)))
    weights = np.array([weight(index.n_docs, int(n)) for n in frequencies(index, terms)], np.int64)
    number = {t: i for i, t in enumerate(terms)}
    asked = [(item_id, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for item_id, c in block]
    sent = index.shards.sparkSession.sparkContext.broadcast((terms, weights, asked))
    kind = "item int, item_id long, doc_id long, score long"

    def run(batches):
        terms, weights, asked = sent.value
        wanted, best = pa.array(terms, pa.binary()), [[] for _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                at = pc.index_in(wanted, value_set=pa.array(row["terms"].split(b"\n"), pa.binary())).fill_null(-1).to_numpy()
                shard = Shard(row)
                out = []
                for i, (item_id, own, times) in enumerate(asked):
                    w = weights[own] * times
                    here = (at[own] >= 0) & (w > 0)
                    least = best[i][0] if len(best[i]) == k else 1
                    for score, x in shard.best(at[own][here], w[here], k, least):
                        out.append((first + i, item_id, int(shard.ids[x]) if shard.known[x] else None, score))
                        (heapq.heappushpop if len(best[i]) == k else heapq.heappush)(best[i], score)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in kind.split(", ")])

    return arrow_step(index.shards, run, kind)


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents. Answers of a block are written before the next is asked."""
    spark = items.sparkSession
    path, first = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}", 0
    for block in blocks(items):
        _answers(index, block, first, k).write.mode("append").parquet(path)
        first += len(block)
    if not first:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = spark.read.schema("item int, item_id long, doc_id long, score long").parquet(path)
    # Each task keeps its own k best of an item before rows are shuffled.
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB's form over documents and benchmark.
SEARCH_SQL = r"""
WITH terms AS (SELECT d.rid, d.doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents) AS d),
postings AS (SELECT rid, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY rid),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term, docs),
asked AS (SELECT qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)),
scored AS (SELECT qid, item_id, rid, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // corpus.terms)))) AS BIGINT) AS score
  FROM asked JOIN postings AS p USING (term) JOIN weights USING (term) JOIN lengths USING (rid), corpus GROUP BY qid, item_id, rid, p.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
