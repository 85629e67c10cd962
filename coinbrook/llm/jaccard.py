"""Similarity join of documents by word shingles, along chosen paths.

Sets of five-word shingles are joined if their Jaccard similarity is THRESHOLD or more.

1. Equal sets are counted and one document stands for each.
2. Each representative has COORDINATES min-hashes. A run starts with one node that
   holds every representative. At a node each coordinate is chosen with probability
   1 / (THRESHOLD * COORDINATES), by the node's own hash, and the members part by
   their value there: similar sets stay together on about one path or more at each
   level. A bucket of BUCKET members or fewer is compared by brute force; a larger
   one is split again, up to DEPTH levels; what is still large then shares DEPTH
   sampled shingles and goes on as a whole. Runs are repeated until a pair at the
   threshold meets with probability RECALL. Runs differ only in their seed and are
   taken level by level together.
3. What meets in a bucket and looks similar (by min-hash, with a margin) is linked by
   a spanning forest; the forests' components hold every link.
4. Inside a component all pairs are compared exactly, in blocks of bounded size, so
   that each document knows its number of links and the exact classes follow. Blocks
   give counts and forests, not pairs.

Defined results: a null or empty text has no words and is a class of its own without
links; texts with fewer than five words are one shingle; equal rows are copies: they
share a class and count as links; a null doc_id is a document like others. The
class id is the smallest doc_id of the class (nulls last). An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, documents, partitions, slices
from coinbrook.llm.shingles import shingle_hashes, word_hashes, words

THRESHOLD, RECALL = 0.8, 0.999
COORDINATES = 64
BUCKET, DEPTH = 128, 3
#: Min-hash estimates below this are no candidates: four standard deviations under the threshold.
MARGIN = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
#: Size of a block, in shingles and SET_COST for each set; a pair of blocks is in memory at once.
BLOCK_SHINGLES, SET_COST = 500_000, 200
#: Null ids sort last.
NO_ID = (1 << 63) - 1

_FACTORS, _SHIFTS = np.random.default_rng(20240501).integers(0, (1 << 64) - 1, (2, COORDINATES), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold has met with probability ``recall``, also if it needs ``depth`` levels: each level keeps it on a Poisson number of paths with mean 1."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def min_hashes(shingles: np.ndarray) -> bytes:
    """COORDINATES 32-bit minima under multiply-shift hashing."""
    out = np.empty(COORDINATES, np.uint32)
    for i in range(COORDINATES):
        out[i] = (((shingles ^ _SHIFTS[i]) * _FACTORS[i]) >> np.uint64(32)).min()
    return out.tobytes()


def sketches(df: DataFrame) -> DataFrame:
    """did (the id, nulls last), dh (the text's hash), set hash, size and min-hashes of each row; without words s1 is null."""
    kind = "did long, dh long, s1 long, s2 long, size long, sig binary"

    def run(batches):
        memo: dict[str, int] = {}
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                s = np.unique(shingle_hashes(word_hashes(words(text), memo)))
                if len(s):
                    h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    rows.append((int(h[0]), int(h[1]), len(s), min_hashes(s)))
                else:
                    rows.append((None, None, 0, None))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("dh"), *(pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=[x.split()[0] for x in kind.split(", ")])

    docs = documents(df).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("dh"), "text")
    return arrow_step(docs, run, kind)


def _node_choices(nodes: np.ndarray) -> np.ndarray:
    """Which coordinates each node splits by (rows: nodes)."""
    i = np.arange(COORDINATES, dtype=np.uint64)
    h = (nodes[:, None] ^ (i[None, :] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53) < 1 / (THRESHOLD * COORDINATES)


def _child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    h = (node + coordinate.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (value.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x8EBC6AF09C88C6E3)
    return h ^ (h >> np.uint64(32))


def split(members: DataFrame) -> DataFrame:
    """rep and node of the children of (rep, node, sig), one row for each path taken."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            rep, lists = batch.column("rep").to_numpy(zero_copy_only=False), batch.column("nodes")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            node = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(node), 20_000):
                nodes, rows = node[s : s + 20_000], row[s : s + 20_000]
                different, back = np.unique(nodes, return_inverse=True)
                at, coordinate = np.nonzero(_node_choices(different)[back])
                child = _child(nodes[at], coordinate, sig[rows[at], coordinate])
                yield pa.RecordBatch.from_arrays([pa.array(rep[rows[at]]), pa.array(child.view(np.int64))], names=["rep", "node"])

    return arrow_step(members.select("rep", "sig", "nodes"), run, "rep long, node long")


def roots(n_runs: int):
    h = np.random.default_rng(20240503).integers(-(1 << 62), 1 << 62, n_runs)
    return F.array(*[F.lit(int(x)) for x in h])


def _forest(links: np.ndarray, n: int) -> np.ndarray:
    """The links that join components not yet joined."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(links.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return links[kept]


def bucket_links(members: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the similar-looking pairs of each small bucket (rep, node, sig)."""

    def links(reps, sigs):
        sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDINATES)
        a, b = np.triu_indices(len(reps), 1)
        near = (sig[a] == sig[b]).mean(axis=1) >= MARGIN
        if not near.any():
            return []
        return [(reps[i], reps[j]) for i, j in _forest(np.stack([a[near], b[near]], 1), len(reps)).tolist()]

    def run(batches):
        node, reps, sigs, out = None, [], [], []
        for batch in batches:
            for n, rep, sig in zip(*(batch.column(c).to_pylist() for c in ("node", "rep", "sig")), strict=True):
                if n != node:
                    if len(reps) > 1:
                        out += links(reps, sigs)
                    node, reps, sigs = n, [], []
                reps.append(rep)
                sigs.append(sig)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if len(reps) > 1 and (out := links(reps, sigs)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    n = partitions(members.sparkSession)
    return arrow_step(members.select("node", "rep", "sig").repartition(n, "node").sortWithinPartitions("node"), run, "a long, b long")


def candidate_links(reps: DataFrame, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """a, b: links whose components hold every pair that met. ``reps``: rep, sig."""
    found = None
    level = reps.withColumn("nodes", roots(runs_for(recall, depth)))
    for d in range(depth):
        children = cut(split(level))
        # Written, so that the join's sides are plain shuffles and a node with many members can be split.
        sizes = cut(children.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1"))
        met = cut(children.join(sizes, "node"))
        small = bucket_links(met.filter(F.col("n") <= bucket).join(reps, "rep"))
        found = small if found is None else found.unionByName(small)
        large = met.filter((F.col("n") > bucket))
        if d == depth - 1:
            found = found.unionByName(large.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")))
        elif large.isEmpty():
            break
        else:
            # One row for each representative: its signature is joined once for all its nodes.
            level = large.groupBy("rep").agg(F.collect_list("node").alias("nodes")).join(reps, "rep")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (the component's least node) of every node in ``links`` (a, b).

    Each node points at the least neighbour's pointer until nothing changes; pointers
    are also followed, so that chains shorten by half. Only sums reach the driver.
    """
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        # Written before the jump, so that both sides of that join are plain shuffles and a label that many nodes share can be split.
        stepped = cut(label.join(near, label["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label")))
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("l"))
        new = cut(stepped.join(jump, "label").select("node", "old", F.least("label", "l").alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def _similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Index pairs of sets with similarity THRESHOLD or more, between two blocks or inside one; sets are sorted arrays without repeats."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    # Shingles of one set only can't be shared; groups of shingles with the same owners count once, weighted.
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(values)])
    keep = count > 1
    start, count = start[keep], count[keep]
    columns: dict[bytes, int] = {}
    weights: list[int] = []
    members: list[np.ndarray] = []
    for s, c in zip(start.tolist(), count.tolist(), strict=True):
        own = owner[s : s + c]
        k = columns.setdefault(own.tobytes(), len(weights))
        if k == len(weights):
            weights.append(0)
            members.append(own)
        weights[k] += 1
    n, split_at = len(sets), len(left) if right is not None else 0
    out = []
    a_rows = np.arange(len(left))
    for s in range(0, len(a_rows), 512):
        rows = a_rows[s : s + 512]
        common = np.zeros((len(rows), n), np.float32)
        for c0 in range(0, len(members), 2048):
            some = members[c0 : c0 + 2048]
            col = np.repeat(np.arange(len(some)), [len(m) for m in some])
            who = np.concatenate(some)
            dense = np.zeros((n, len(some)), np.float32)
            dense[who, col] = 1
            common += (dense[rows] * np.array(weights[c0 : c0 + 2048], np.float32)) @ dense.T
        near = common.astype(np.float64) >= THRESHOLD * (sizes[rows][:, None] + sizes[None, :] - common) - 1e-9
        i, j = np.nonzero(near)
        i = rows[i]
        ok = j >= split_at if right is not None else j > i
        out.append(np.stack([i[ok], j[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def exact_links(df: DataFrame, members: DataFrame) -> DataFrame:
    """Counts and forests of the exact links inside components.

    members: set_id, label, rep, dh, size, copies. Each component is dealt into blocks of about
    BLOCK_SHINGLES shingles; a task compares a pair of blocks. Rows: set_id and links (other
    documents, copies counted) with other = null, and forest links set_id - other.
    """
    totals = members.groupBy("label").agg(F.sum(F.col("size") + SET_COST).alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    placed = members.join(totals, "label").withColumn("k", blocks).withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("k")).cast("int"))
    texts = documents(df).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("dh"), "text")
    # Always a merge join: texts are moved once at every size, whatever the members' side happens to weigh.
    chosen = placed.join(texts.hint("merge"), (placed["rep"] == texts["did"]) & (placed["dh"] == texts["dh"])).select("label", "set_id", "copies", "k", "block", "text")
    shape = "label long, set_id long, copies long, k int, block int, shingles binary"

    def to_sets(batches):
        memo: dict[str, int] = {}
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(word_hashes(words(t), memo))).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "set_id", "copies", "k", "block")), pa.array(sets, pa.binary())], names=[x.split()[0] for x in shape.split(", ")])

    sets = arrow_step(chosen, to_sets, shape)
    # The pair of blocks (i, j), i <= j; a set goes to every pair that its block is in.
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "copies", "shingles")
    kind = "set_id long, links long, other long"

    def compare(batches):
        key, rows = None, {}

        def done():
            if key is None:
                return None
            inside = key[1] == key[2]
            all_rows = list(rows.values())
            left = [r for r in all_rows if r[0] == key[1]]
            right = None if inside else [r for r in all_rows if r[0] == key[2]]
            if not left or (right is not None and not right) or len(all_rows) < 2:
                return None
            sides = left + (right or [])
            near = _similar_pairs([r[3] for r in left], None if inside else [r[3] for r in right])
            if not len(near):
                return None
            copies = np.array([r[2] for r in sides], np.float64)
            links = np.bincount(near[:, 0], copies[near[:, 1]], len(sides)) + np.bincount(near[:, 1], copies[near[:, 0]], len(sides))
            ids = np.array([r[1] for r in sides], np.int64)
            forest, some = _forest(near, len(sides)), np.flatnonzero(links)
            rep = np.r_[ids[some], ids[forest[:, 0]]]
            count = pa.array(np.r_[links[some], np.zeros(len(forest))].astype(np.int64))
            other = pa.array(np.r_[np.zeros(len(some), np.int64), ids[forest[:, 1]]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(forest), bool)])
            return pa.RecordBatch.from_arrays([pa.array(rep), count, other], names=["set_id", "links", "other"])

        for batch in batches:
            for label, i, j, block, rep, copies, data in zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j", "block", "set_id", "copies", "shingles")), strict=True):
                if key != (label, i, j):
                    if (out := done()) is not None:
                        yield out
                    key, rows = (label, i, j), {}
                rows[rep] = (block, rep, copies, np.frombuffer(data, np.uint64))
        if (out := done()) is not None:
            yield out

    n = partitions(df.sparkSession)
    return arrow_step(pairs.repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j"), compare, kind)


def join(df: DataFrame, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id, n_links, n_copies (rows with the same set, itself included), dh (the text's hash) and class_no, a row for each row of ``df``.

    class_no tells classes apart even where different documents share an id.
    """
    rows = cut(sketches(df))
    # The document that stands for a set: its smallest id, then text hash.
    kinds = rows.filter("s1 is not null").groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min("did").alias("rep"))
    per_set = rows.filter("s1 is not null").join(kinds, ["s1", "s2"]).filter("did = rep").groupBy("s1", "s2", "rep", "copies").agg(F.min("dh").alias("dh"), F.min("size").alias("size"), F.first("sig").alias("sig"))
    # Sets are named by a number: ids may repeat over different texts.
    named = cut(per_set.withColumn("set_id", F.xxhash64("s1", "s2")))
    links = cut(candidate_links(named.select(F.col("set_id").alias("rep"), "sig"), recall, bucket, depth))
    members = cut(named.drop("sig").join(components(links).select(F.col("node").alias("set_id"), "label"), "set_id"))
    found = cut(exact_links(df, members))
    counts = found.filter("other is null").groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = components(found.filter("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    labelled = named.select("s1", "s2", "set_id", "rep", "copies").join(counts, "set_id", "left").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    final = labelled.join(least, "label").select("s1", "s2", "class_id", F.col("label").alias("class_no"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    with_words = rows.filter("s1 is not null").join(final, ["s1", "s2"]).select(real("did").alias("doc_id"), real("class_id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), "dh", "class_no")
    without = rows.filter("s1 is null").select(real("did").alias("doc_id"), real("did").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "dh", F.xxhash64("did", "dh", F.lit("without words")).alias("class_no"))
    return with_words.unionByName(without)
