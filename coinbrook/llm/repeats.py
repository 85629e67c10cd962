"""Removal of repeated passages with a distributed sparse suffix array.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else.

1. Anchors. In every window of WINDOW bytes the GRAM-byte string with the smallest
   hash (the leftmost of equals) is its anchor, so equal windows have equal anchors
   at equal offsets, and only the suffixes that start at anchors have to be
   compared: about one position in 170. An anchor's context is the union of the
   windows that chose it.
2. Anchor strings are counted; those that occur once are done. Equal contexts are
   counted too: they repeat as a whole, and one of them stands for all.
3. The remaining contexts are dealt by ``repartitionByRange`` on the suffixes' leading
   GRAM bytes (Spark samples the splitters), so suffixes that share them are in one
   bucket, and neighbours on both sides of a splitter share less than GRAM bytes and
   cannot repeat each other.
4. Buckets sort their suffixes, and the reversed left sides, by multikey quicksort on
   eight-byte digits. Neighbours' common prefixes give, for each offset, the classes
   of equal right and left parts; a window repeats if its pair of classes does.

A run of more than HOT_CONTEXTS different contexts of one anchor string is not held in
a bucket: its windows are counted by 128-bit hash in an aggregation, which pre-sums in
each task.

Passages that texts share as words, however short these are, whatever blanks stand between
them and in whatever case, go the same way at the same time: a text's words are a string of
eight-byte hashes, and a passage of WORDS of them a window that starts at a multiple of
eight. Its anchors are told apart by the lowest bit of their hash. Nothing is removed by
this; ``n_shared_words`` counts it.

Of equal hashes in a window the leftmost is its anchor, so a run of one byte or of a
short period has an anchor at each byte: that costs rows, not results.

Defined results: a null or empty text has nothing to remove; equal rows are copies of
each other; texts below WINDOW bytes stay, and share no words below WORDS; words are
parted by the six ASCII blanks; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, documents, partitions, slices

WINDOW, GRAM = 400, 64
#: Words of a shared passage (more than 50), and bytes of a word's hash.
WORDS, WORD = 51, 8
#: Different contexts of one anchor string that a bucket compares itself.
HOT_CONTEXTS = 16_384
#: Contexts compared at once if runs are small, and offsets at once.
CHUNK, OFFSETS = 4096, 64
#: Low half of a word for positions, beyond the 2 GB that a string can have.
_POSITION = (1 << 32) - 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` (a power of two) bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    n = 1
    while n < gram:
        h = _mix(h[:-n], h[n:])
        n *= 2
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Anchors of texts joined in ``data``: place, first and last window start, gram hash, index of the text."""
    none = np.zeros(0, np.int64)
    reach = window - gram + 1
    if len(data) < window:
        return none, none, none, none.astype(np.uint64), none
    hashed = gram_hashes(data, gram)
    low = (hashed & ~np.uint64(_POSITION)) | np.arange(len(hashed), dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    chosen = (low & np.uint64(_POSITION)).astype(np.int64)  # by window start
    at = np.arange(len(chosen))
    text = np.searchsorted(starts, at, side="right") - 1
    fits = at + window <= ends[text]
    at, chosen, text = at[fits], chosen[fits], text[fits]
    if not len(at):
        return none, none, none, none.astype(np.uint64), none
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    return chosen[new], at[new], at[last], hashed[chosen[new]], text[new]


def word_string(text: str) -> bytes:
    """The hashes of a text's words in lower case, WORD bytes each."""
    words = text.lower().encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).tobytes()


def kind(words: bool) -> tuple[int, int]:
    """Bytes of a window, and those between the starts of two."""
    return (WORDS * WORD, WORD) if words else (WINDOW, 1)


def of_words():
    """Whether an anchor is one of words."""
    return F.col("kh").bitwiseAND(1) == 1


def window_bytes():
    return F.when(of_words(), kind(True)[0]).otherwise(kind(False)[0])


def keyed(df: DataFrame) -> DataFrame:
    """Rows by content: did and dh name a document by its id and its text's hash; equal rows share them."""
    docs = documents(df)
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text", F.lit(1)).alias("dh"), "text")


_ANCHOR = "did long, dh long, place int, o int, more int, kh long, c long"


def anchor_table(docs: DataFrame) -> DataFrame:
    """A row for each anchor: its document, place, the bytes from its first window's start to it and to its last window's start (small numbers, which take little room), gram hash and the context's hash, which decides between contexts of one gram hash."""
    names = [x.split()[0] for x in _ANCHOR.split(", ")]

    def found(batch, strings: list[bytes], words: bool) -> pa.RecordBatch:
        window, step = kind(words)
        sizes = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = b"".join(strings)
        place, first, last, kh, text = anchors(np.frombuffer(joined, np.uint64 if words else np.uint8), starts // step, ends // step, window // step, GRAM // step)
        place, first, last = place * step, first * step, last * step
        # The seed is the anchor's offset, so that equal hashes mean equal contexts around equal places.
        c = np.fromiter((xxhash.xxh3_64_intdigest(joined[f : e + window], seed=p - f) for p, f, e in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(place))
        base = starts[text] if len(text) else text
        ids = [batch.column(n).to_numpy(zero_copy_only=False)[text] for n in ("did", "dh")]
        kh = (kh & ~np.uint64(1)) | np.uint64(words)
        cols = [*ids, *(x.astype(np.int32) for x in (place - base, place - first, last - first)), kh.view(np.int64), c.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield found(batch, [t.encode() for t in texts], False)
            yield found(batch, [word_string(t) for t in texts], True)

    # WORDS words take a byte and a blank each.
    return arrow_step(docs.filter(F.octet_length("text") >= 2 * WORDS - 1).select("did", "dh", "text"), run, _ANCHOR)


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a uint8 matrix: by eight-byte digits, each digit sorting only rows that are equal so far."""
    n, width = rows.shape
    digits = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8")
    order, part = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)
    for k in range(digits.shape[1]):
        if len(open_) < 2:
            break
        key = digits[order[open_], k].astype(np.uint64)
        by = np.lexsort((key, part[open_]))
        order[open_], key = order[open_][by], key[by]
        new = np.r_[True, (np.diff(part[open_]) != 0) | (key[1:] != key[:-1])]
        part[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        size = np.bincount(np.cumsum(new) - 1)
        open_ = open_[np.repeat(size > 1, size)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), CHUNK):
        a, b = rows[order[s : s + CHUNK]], rows[order[s - 1 : s - 1 + CHUNK]][: len(order) - s]
        differ = a != b
        out[s : s + CHUNK] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated_offsets(contexts: list[bytes], left: np.ndarray, copies: np.ndarray, owner: np.ndarray, words: bool = False) -> list[list[tuple[int, int, bool]]]:
    """For each context the runs (a, b, other) of offsets (anchor minus window start) whose window occurs again among ``contexts``; ``other`` if one of them does so under another ``owner``. Of words only those that do so."""
    window, step = kind(words)
    n, reach = len(contexts), window - GRAM
    steps = reach // step + 1
    ranked = np.argsort(owner, kind="stable")
    contexts, left, copies, owner = [contexts[i] for i in ranked], left[ranked], copies[ranked], owner[ranked]
    right_side, left_side = np.zeros((n, window), np.uint8), np.zeros((n, reach), np.uint8)
    for i, (c, o) in enumerate(zip(contexts, left.tolist(), strict=True)):
        row = np.frombuffer(c, np.uint8)
        right_side[i, : len(c) - o] = row[o:]
        left_side[i, :o] = row[:o][::-1]
    least = window - (np.array([len(c) for c in contexts]) - left)
    ordered = [(o := multikey_sort(m), common_prefixes(m, o)) for m in (right_side, left_side)]
    marks, elsewhere = np.zeros((2, n, steps), bool)
    for s in range(0, steps, OFFSETS):
        of_step = np.arange(s, min(s + OFFSETS, steps))
        offset = of_step * step
        classes = []
        for (order, lcp), need in zip(ordered, (window - offset, offset), strict=True):
            of = np.empty((n, len(offset)), np.int64)
            of[order] = np.cumsum(lcp[:, None] < need[None, :], axis=0)
            classes.append(of)
        valid = (offset[None, :] >= least[:, None]) & (offset[None, :] <= left[:, None])
        code = np.where(valid, classes[0] * (n + 1) + classes[1], -1 - np.arange(n)[:, None]).T
        # Stable, so that each class is in the order of its owners: its ends tell whether they differ.
        by = np.argsort(code, axis=1, kind="stable")
        in_order, whose = np.take_along_axis(code, by, axis=1), owner[by]
        same = in_order[:, 1:] == in_order[:, :-1]
        column = np.arange(n)[None, :]
        first = np.maximum.accumulate(np.where(np.pad(~same, ((0, 0), (1, 0)), constant_values=True), column, 0), axis=1)
        last = np.minimum.accumulate(np.where(np.pad(~same, ((0, 0), (0, 1)), constant_values=True), column, n)[:, ::-1], axis=1)[:, ::-1]
        differ = np.take_along_axis(whose, first, axis=1) != np.take_along_axis(whose, last, axis=1)
        for found, out_of in ((first < last, marks), (differ, elsewhere)):
            back = np.empty_like(found)
            np.put_along_axis(back, by, found, axis=1)
            out_of[:, of_step] = back.T & valid
        marks[:, of_step] |= (copies > 1)[:, None] & valid
    if words:
        marks = elsewhere
    edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int, bool]]] = [[] for _ in range(n)]
    for (i, a), (_, b) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist(), strict=True):
        out[ranked[i]].append((a * step, (b - 1) * step, bool(elsewhere[i, a:b].any())))
    return out


_CONTEXT = "did long, dh long, place int, kh long, n long, spread boolean, o int, context binary"


def fetch_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the contexts in ``wanted``, cut out where their texts are; one row a text is joined."""
    lists = wanted.groupBy("did", "dh").agg(F.collect_list(F.struct("place", "o", "more", "kh", "n", "spread")).alias("all"))
    joined = docs.select("did", "dh", "text").join(lists, ["did", "dh"])
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches):
        before = None
        for batch in slices(batches):
            rows = []
            for did, dh, text, places in zip(*(batch.column(c).to_pylist() for c in ("did", "dh", "text", "all")), strict=True):
                # Equal rows, which the join puts beside each other, give the same contexts: one of them is enough.
                if (did, dh) == before:
                    continue
                before = did, dh
                for words in {x["kh"] & 1 for x in places}:
                    data, window = word_string(text) if words else text.encode(), kind(words)[0]
                    rows += [(did, dh, x["place"], x["kh"], x["n"], x["spread"], x["o"], data[x["place"] - x["o"] : x["place"] - x["o"] + x["more"] + window]) for x in places if x["kh"] & 1 == words]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return arrow_step(joined, run, _CONTEXT)


_SPAN = "did long, dh long, kh long, lo long, hi long, other boolean"


def _spans(rows: list[tuple], offsets: list[list[tuple[int, int, bool]]], window: int) -> pa.RecordBatch:
    """Byte spans of repeated windows; rows: did, dh, kh, place."""
    out = [(did, dh, kh, place - b, place - a + window, other) for (did, dh, kh, place), runs in zip(rows, offsets, strict=True) for a, b, other in runs]
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_())], names=[x.split()[0] for x in _SPAN.split(", ")])


def bucket_spans(contexts: DataFrame, n_buckets: int) -> DataFrame:
    """Spans found inside the buckets of the suffix array."""
    suffix = contexts.withColumn("lead", F.expr(f"substring(context, o + 1, {GRAM})"))

    def run(batches):
        held: list[tuple] = []

        def flush(rows, words):
            # Copies in several documents are an owner of their own: whatever equals them is elsewhere too.
            owners = {key: k for k, key in enumerate(dict.fromkeys(r[:2] for r in rows))}
            owner = np.array([-1 - k if r[8] else owners[r[:2]] for k, r in enumerate(rows)], np.int64)
            offsets = repeated_offsets([r[6] for r in rows], np.array([r[5] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64), owner, words)
            # What has copies repeats as a whole and is marked without this, unless all copies are in one document.
            offsets = [x if not r[8] else [] for r, x in zip(rows, offsets, strict=True)]
            return _spans([r[:4] for r in rows], offsets, kind(words)[0])

        def both(rows):
            # Equal rows may have met different tasks of a join that was split; their contexts are here together.
            rows = list({r[:4]: r for r in rows}.values())
            for words in (False, True):
                if some := [r for r in rows if r[2] & 1 == words]:
                    yield flush(some, words)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("did", "dh", "kh", "place", "n", "o", "context", "lead", "spread")), strict=True):
                if len(held) >= CHUNK and row[7] != held[-1][7]:
                    yield from both(held)
                    held = []
                held.append(row)
        yield from both(held)

    return arrow_step(suffix.repartitionByRange(n_buckets, "lead").sortWithinPartitions("lead"), run, _SPAN)


def hot_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchor strings with too many contexts for a bucket: windows counted by 128-bit hash."""
    schema = "did long, dh long, kh long, n long, spread long, start long, w1 long, w2 long"

    def run(batches):
        for batch in batches:
            for did, dh, kh, place, n, spread, o, c in zip(*(batch.column(x).to_pylist() for x in ("did", "dh", "kh", "place", "n", "spread", "o", "context")), strict=True):
                window, step = kind(kh & 1)
                at = np.arange(0, len(c) - window + 1, step)
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(c[i : i + window]) for i in at.tolist()), np.int64).reshape(-1, 2)
                full = lambda x: pa.array(np.full(len(at), x, np.int64))
                yield pa.RecordBatch.from_arrays([full(did), full(dh), full(kh), full(n), full(spread), pa.array(at + (place - o)), pa.array(w[:, 0]), pa.array(w[:, 1])], names=[x.split()[0] for x in schema.split(", ")])

    windows = arrow_step(contexts.select("did", "dh", "kh", "place", "n", "spread", "o", "context"), run, schema)
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total"), (_differ() | (F.max("spread") > 0)).alias("other")).filter("total > 1")
    found = windows.join(twice, ["w1", "w2"]).filter(~of_words() | F.col("other"))
    return found.select("did", "dh", "kh", F.col("start").alias("lo"), (F.col("start") + window_bytes()).alias("hi"), "other")


def _differ():
    """Whether a group has more than one document."""
    return (F.min("did") != F.max("did")) | (F.min("dh") != F.max("dh"))


def find_spans(docs: DataFrame, hot: int = HOT_CONTEXTS) -> DataFrame:
    """did, dh, words, lo, hi, other: byte spans covered by repeated windows, overlapping ones included; ``other`` if a window of the span is in another document too, as all ``words`` are (WORD bytes a word)."""
    spark = docs.sparkSession
    all_anchors = cut(anchor_table(docs))
    # Longs only, so that each task sums in a hash table before the shuffle. Written, so that the join's
    # sides are plain shuffles and an anchor string that many texts share can be split.
    again = cut(all_anchors.groupBy("kh").count().filter("count > 1").select("kh"))
    candidates = cut(all_anchors.join(again, "kh"))
    firsts = [F.first(c).alias(c) for c in ("did", "dh", "place", "o", "more")]
    kinds = cut(candidates.groupBy("kh", "c").agg(F.count("*").alias("n"), _differ().alias("spread"), *firsts))
    copies = kinds.filter(F.col("spread") | (~of_words() & (F.col("n") > 1)))
    lo = (F.col("place") - F.col("o")).cast("long")
    whole = candidates.join(copies.select("kh", "c", "spread"), ["kh", "c"]).select("did", "dh", "kh", lo.alias("lo"), (lo + F.col("more") + window_bytes()).alias("hi"), F.col("spread").alias("other"))
    # Anchor strings with one context are done.
    several = kinds.groupBy("kh").count().filter("count > 1").select("kh", (F.col("count") > hot).alias("large"))
    contexts = fetch_contexts(docs, kinds.join(several, "kh").withColumn("n", F.when(F.col("large"), -F.col("n")).otherwise(F.col("n"))))
    contexts = cut(contexts)
    inside = bucket_spans(contexts.filter("n > 0"), partitions(spark))
    beyond = hot_spans(contexts.filter("n < 0").dropDuplicates(["did", "dh", "kh", "place"]).withColumn("n", -F.col("n")))
    return whole.unionByName(inside).unionByName(beyond).select("did", "dh", of_words().alias("words"), "lo", "hi", "other")


def joined_up(spans: list[dict] | None) -> list[dict]:
    """Sorted spans, those that touch as one."""
    merged: list[dict] = []
    for x in spans or []:
        if merged and x["lo"] <= merged[-1]["hi"]:
            merged[-1]["hi"] = max(merged[-1]["hi"], x["hi"])
        else:
            merged.append(dict(x))
    return merged


def remove(df: DataFrame, hot: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats_elsewhere, n_shared_words and removed (byte spans), a row for each row of ``df``.

    repeats_elsewhere: a removed string is in another document too (another id or another text), not in this one alone.
    n_shared_words: words of passages of WORDS words or more that another document has too.
    """
    docs = keyed(df)
    span = F.struct("lo", "hi")
    spans = find_spans(docs, hot).groupBy("did", "dh").agg(
        F.sort_array(F.collect_set(F.when(~F.col("words"), span))).alias("spans"),
        F.sort_array(F.collect_set(F.when(F.col("words"), span))).alias("shared"),
        F.max(F.col("other") & ~F.col("words")).alias("other"),
    )
    joined = docs.join(spans, ["did", "dh"], "left").select("doc_id", "text", "spans", "shared", F.coalesce("other", F.lit(False)).alias("other"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats_elsewhere boolean, n_shared_words long, removed array<struct<lo:long,hi:long>>"
    removed_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text, spans_, shared in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "shared")), strict=True):
                data, merged = text.encode(), joined_up(spans_)
                kept, at = hashlib.sha256(), 0
                for x in merged:
                    kept.update(data[at : x["lo"]])
                    at = x["hi"]
                kept.update(data[at:])
                words = sum(x["hi"] - x["lo"] for x in joined_up(shared)) // WORD
                rows.append((len(data), sum(x["hi"] - x["lo"] for x in merged), len(merged), kept.hexdigest(), words, merged))
            c = list(zip(*rows, strict=True))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), batch.column("other"), pa.array(c[4], pa.int64()), pa.array(c[5], removed_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return arrow_step(joined, run, schema)
