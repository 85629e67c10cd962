"""Repair of conversation structure by a rank-compressed dynamic programme.

A repaired conversation's role initials match ``(s?(ua)+)?``. Rows are kept (0), given the role
user or assistant (1) or deleted (2, which blank and repeated ones have to be), a truncated row
that stays adds 5, and an empty turn may be inserted anywhere (5). Of the cheapest edits those
are taken whose initials (D, I, K, R), in order, read least.

The automaton has four states (start, after s, after u, after a), and in each only one of user
and assistant can come next, so that an edit's initial says all. A macro is a run of inserts and
the edit of one row; no macro's code starts another's, so that two audits of as many rows
compare as their macros do, row by row. A layer of the programme hence needs no audit strings:
it has, for each state, the cost and the rank of its audit among the layer's, and the parent
(state and macro) from which the edits are read off afterwards. A run of inserts before a
deleted row could as well stand after it and read less, so rows that have to go take no part.

Conversations are not gathered in one place to be solved. Rows without their texts (texts have
hashes) are sorted over all tasks by conversation and turn; each block of BLOCK rows of a
conversation is summarised as costs and ranks between all pairs of states; the blocks' summaries
are composed along a conversation, which fixes the states at the blocks' ends; and then each
block reads off its edits. Only the digest of a repaired conversation, which SHA-256 makes
sequential, passes its texts through one task, one row at a time.

Defined results: a null in any column is one space, save that an unknown turn stays unknown in
``gaps`` and sorts first; an empty text is blank; a role other than s, u and a in its first
letter can't be kept; rows of one turn go by role, then by the text's first 64 characters, then
by its hash; repeated rows are duplicates of the first; a null conv_id is a conversation of its
own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from coinbrook.llm.common import arrow_step, cut, partitions

#: Rows of a conversation that one summary covers at most.
BLOCK = 1 << 14
BLANKS = " \t\n\x0b\x0c\r"

START, S, U, A = range(4)
#: Macros in the order of their codes.
CODES = ("D", "IIK", "IIR", "IK", "IR", "K", "R")
_KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_NEXT = {START: U, S: U, U: A, A: U}
_ROLE = {U: "user", A: "assistant"}
#: Inserts that complete a conversation after its last row.
_TRAILING = {START: "", A: "", U: "I", S: "II"}
_FORCED = dict(zip("1234", "suao", strict=True))

Cell = tuple[int, int] | None


@functools.cache
def moves(letter: str, state: int) -> tuple[tuple[int, int, int], ...]:
    """(macro, cost, next state) for a row of ``letter`` (its initial, or o; upper case if truncated)."""
    out, own, more = [(0, 2, state)], letter.lower(), 5 if letter.isupper() else 0
    for n in range(3):
        if (state, own) in _KEPT:
            out.append((CODES.index("I" * n + "K"), 5 * n + more, _KEPT[state, own]))
        out.append((CODES.index("I" * n + "R"), 5 * n + 1 + more, _NEXT[state]))
        state = _NEXT[state]
    return tuple(out)


@functools.lru_cache(1 << 16)
def advance(cells: tuple[Cell, ...], letter: str) -> tuple[tuple[Cell, ...], int, tuple]:
    """The next layer from ``cells`` (16: from each state, to each state), what all its costs were lessened by, and the cells' parents."""
    best: list = [None] * 16
    for i, cell in enumerate(cells):
        if cell:
            for code, cost, to in moves(letter, i % 4):
                found = (cell[0] + cost, cell[1], code, i % 4)
                j = i - i % 4 + to
                if best[j] is None or found < best[j]:
                    best[j] = found
    ranks = {x: n for n, x in enumerate(sorted({b[1:3] for b in best if b}))}
    least = min(b[0] for b in best if b)
    return tuple((b[0] - least, ranks[b[1:3]]) if b else None for b in best), least, tuple((b[3], b[2]) if b else None for b in best)


FIRST_LAYER: tuple[Cell, ...] = tuple((0, 0) if i // 4 == i % 4 else None for i in range(16))


def solve(letters: str, counts: list[int]) -> tuple[int, tuple[Cell, ...], list]:
    """Cost that all paths have in common, last layer, and the parents of each layer, for rows of ``letters``; ``counts``: a row and its repeats."""
    cells, base, trail = FIRST_LAYER, 0, []
    for letter, n in zip(letters, counts, strict=True):
        if letter in _FORCED:
            base += 2 * n
            continue
        cells, least, parents = advance(cells, letter)
        base += least + 2 * (n - 1)
        trail.append(parents)
    return base, cells, trail


def edits(letters: str, counts: list[int], entry: int, leave: int) -> list[tuple[str, list[str], str | None]]:
    """Audit, inserted roles and new role (empty: as it was, None: deleted) of each row, between two states."""
    _, _, trail = solve(letters, counts)
    codes, state = [], leave
    for parents in reversed(trail):
        state, code = parents[4 * entry + state]
        codes.append(CODES[code])
    out, state = [], entry
    for letter, n in zip(letters, counts, strict=True):
        if letter in _FORCED:
            out.append(("D" * n, [], None))
            continue
        code, inserted = codes.pop(), []
        for _ in range(code.count("I")):
            state = _NEXT[state]
            inserted.append(_ROLE[state])
        role = None
        if code[-1] == "K":
            state, role = _KEPT[state, letter.lower()], ""
        elif code[-1] == "R":
            state = _NEXT[state]
            role = _ROLE[state]
        out.append((code + "D" * (n - 1), inserted, role))
    return out


def compose(layer: dict[int, tuple[int, int]], base: int, cells: tuple[Cell, ...]) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """Cost and rank by state after one more block, and the state before it by the state after it."""
    best: dict[int, tuple] = {}
    for m, (cost, rank) in layer.items():
        for x in range(4):
            if cell := cells[4 * m + x]:
                found = (cost + base + cell[0], rank, cell[1], m)
                if x not in best or found < best[x]:
                    best[x] = found
    ranks = {r: n for n, r in enumerate(sorted({b[1:3] for b in best.values()}))}
    return {x: (b[0], ranks[b[1:3]]) for x, b in best.items()}, {x: b[3] for x, b in best.items()}


def path(summaries: list[tuple[int, tuple[Cell, ...]]]) -> tuple[int, list[int], str]:
    """Least cost, the states at the blocks' ends (one more than blocks), and the inserts after the last row."""
    layer, back = {START: (0, 0)}, []
    for base, cells in summaries:
        layer, parents = compose(layer, base, cells)
        back.append(parents)
    cost, _, after, state = min((cost + 5 * len(_TRAILING[x]), rank, _TRAILING[x], x) for x, (cost, rank) in layer.items())
    states = [state]
    for parents in reversed(back):
        states.append(parents[states[-1]])
    return cost, states[::-1], after


def pairs_illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def conversation() -> Column:
    """conv_id as text; one space, which no number is, if unknown."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """The rows that are left after the damage, with how often each stands there (``copies``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", conversation(), text("turn")).cast("binary")) % 20
    rows = df.select(conversation().alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv",
        F.col("turn").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


#: What tells rows of a conversation apart, in their order; texts by their beginning and 128 bits of hash.
ORDER = ("conv", "known", "turn", "role", "head", "h1", "h2")


def keyed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("conv", "known", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), *more)


def turns(rows: DataFrame) -> DataFrame:
    """A row for each different (conversation, turn, role, text), without the text: copies, blank, truncated, and whether it is the first of its role and text."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    one = keyed(rows.withColumn("last", last), "copies", "last").groupBy(*ORDER).agg(F.sum("copies").alias("n"), F.min("last").alias("last"))
    one = cut(one)
    first = one.groupBy("conv", "role", "head", "h1", "h2").agg(F.min(F.struct("known", "turn")).alias("at"))
    # Marked by one more aggregation rather than a join: a text that fills a conversation is spread by turn.
    marks = first.select("conv", F.col("at.known").alias("known"), F.col("at.turn").alias("turn"), "role", "head", "h1", "h2", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("last"), F.lit(1).alias("first"))
    both = one.withColumn("first", F.lit(0)).unionByName(marks).groupBy(*ORDER).agg(F.sum("n").alias("n"), F.min("last").alias("last"), F.max("first").alias("first"))
    return both.withColumns({"blank": F.col("last") == "", "first": F.col("first") == 1})


def counted(rows: DataFrame) -> DataFrame:
    """gaps, blank, duplicate and truncated by conversation."""
    turn = F.when(F.col("known"), F.col("turn"))
    some = lambda cond, n: F.sum(F.when(cond, n).otherwise(0)).cast("long")
    return rows.groupBy("conv").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
        some(F.col("blank"), F.col("n")).alias("blank"),
        some(~F.col("blank"), F.col("n") - F.col("first").cast("long")).alias("duplicate"),
        some(~F.col("blank") & F.col("first") & ~F.col("last").isin(".", "!", "?"), 1).alias("truncated"),
    )


_KEYS = "known boolean, turn long, role string, head string, h1 long, h2 long"
_BLOCKS = "conv string, block long, letters string, counts array<long>, known array<boolean>, turn array<long>, role array<string>, head array<string>, h1 array<long>, h2 array<long>, base long, costs array<int>, ranks array<int>, first string, final string, illegal long"


def blocks(rows: DataFrame) -> DataFrame:
    """Conversations in their order, cut into blocks of BLOCK rows within a task, each with its summary."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    forced = F.col("blank") | ~F.col("first")
    letter = F.when(forced, F.translate(initial, "suao", "1234")).when(F.col("last").isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    spark, order = rows.sparkSession, [F.col(c).asc_nulls_first() for c in ORDER]
    ordered = rows.select(*ORDER, "n", letter.alias("letter")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    names, kinds = [x.split()[0] for x in _BLOCKS.split(", ")], [f.dataType for f in spark.createDataFrame([], _BLOCKS).schema]
    arrow = [to_arrow_type(k) for k in kinds]

    def summary(held: list[dict]) -> tuple:
        letters, counts = "".join(r["letter"] for r in held), [r["n"] for r in held]
        base, cells, _ = solve(letters, counts)
        plain = [_FORCED.get(x, x.lower()) for x in letters]
        illegal = sum(map(pairs_illegal, plain, plain[1:])) + sum((n - 1) * pairs_illegal(x, x) for x, n in zip(plain, counts, strict=True))
        columns = [[r[c] for r in held] for c in ORDER[1:]]
        return (held[0]["conv"], held[0]["seq"], letters, counts, *columns, base, [c[0] if c else -1 for c in cells], [c[1] if c else -1 for c in cells], plain[0], plain[-1], illegal)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and (held[0]["conv"] != row["conv"] or len(held) == BLOCK):
                    out.append(summary(held))
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(summary(held), arrow, strict=True)], names=names)

    return cut(arrow_step(ordered, run, _BLOCKS))


def ends(made: DataFrame) -> DataFrame:
    """entry and leave, the states at each block's ends; with a conversation's last block its cost, illegal pairs and last inserts. A summary is 16 costs and ranks, whatever the block's rows."""
    small = made.select("conv", "block", "base", "costs", "ranks", "first", "final", "illegal").repartition(partitions(made.sparkSession), "conv").sortWithinPartitions("conv", "block")
    kind = "conv string, block long, entry int, leave int, cost long, illegal long, after string"

    def solved(held: list[dict]) -> Iterator[tuple]:
        cost, states, after = path([(r["base"], tuple((c, k) if c >= 0 else None for c, k in zip(r["costs"], r["ranks"], strict=True))) for r in held])
        illegal = sum(r["illegal"] for r in held) + sum(pairs_illegal(a["final"], b["first"]) for a, b in zip(held, held[1:], strict=False))
        for r, entry, leave in zip(held, states, states[1:], strict=False):
            last = r is held[-1]
            yield r["conv"], r["block"], entry, leave, cost if last else 0, illegal if last else 0, after if last else ""

    def run(batches):
        held, types = [], (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in kind.split(", ")])
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    out.extend(solved(held))
                    held = []
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(list(solved(held)))

    return arrow_step(small, run, kind)


_EDITS = "conv string, " + _KEYS + ", audit string, inserted string, new_role string, cost long, illegal long, after string"


def decisions(made: DataFrame) -> DataFrame:
    """Each row's part of the audit, the roles inserted before it (comma-joined), and its role (null: deleted)."""
    both = made.drop("base", "costs", "ranks", "first", "final", "illegal").join(ends(made), ["conv", "block"])
    names = [x.split()[0] for x in _EDITS.split(", ")]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out, n = [], len(r["letters"])
                for i, (audit, inserted, role) in enumerate(edits(r["letters"], r["counts"], r["entry"], r["leave"])):
                    last = i == n - 1
                    own = r["role"][i] if role == "" else role
                    out.append((r["conv"], *(r[c][i] for c in ORDER[1:]), audit, ",".join(inserted), own, r["cost"] if last else 0, r["illegal"] if last else 0, r["after"] if last else ""))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return arrow_step(both, run, _EDITS)


def rebuilt(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Cost, illegal pairs, audit and digest by conversation: decisions and texts meet by sorting, and pass row by row."""
    own = decisions(made).withColumns({"tag": F.lit(0), "text": F.lit(None).cast("string")})
    texts = keyed(rows, "text").withColumn("tag", F.lit(1))
    order = [*ORDER, "tag"]
    both = own.unionByName(texts, allowMissingColumns=True).repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions(*order)
    kind = "conv string, cost long, illegal long, audit string, repaired_sha256 string"

    def run(batches):
        now, waiting, sha, audit, total = None, None, None, [], [0, 0, ""]
        started = False

        def line(role: str, text: str) -> None:
            nonlocal started
            sha.update(("\n" if started else "").encode() + f"{role}:{text}".encode())
            started = True

        def result() -> pa.RecordBatch:
            state = U if total[2] == "I" else START
            for _ in total[2]:
                # After s both turns are inserted, after u the assistant's.
                state = _NEXT[state] if state != START else U
                line(_ROLE[state], "")
            columns = ([now], [total[0]], [total[1]], ["".join(audit) + total[2]], [sha.hexdigest()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in kind.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != now:
                    if now is not None:
                        yield result()
                    now, sha, audit, total, waiting, started = row["conv"], hashlib.sha256(), [], [0, 0, ""], None, False
                if row["tag"] == 0:
                    audit.append(row["audit"])
                    for role in filter(None, row["inserted"].split(",")):
                        line(role, "")
                    waiting = row["new_role"]
                    total = [total[0] + row["cost"], total[1] + row["illegal"], total[2] + row["after"]]
                elif waiting is not None:
                    # The first of equal texts; further copies are deleted.
                    line(waiting, row["text"])
                    waiting = None
        if now is not None:
            yield result()

    return arrow_step(both, run, kind)


def repair(df: DataFrame) -> DataFrame:
    """Damages and repairs the conversations of ``df`` (conv_id, turn, role, text): a row for each conv_id that it has."""
    return repaired(df, damaged(df))


def repaired(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The faults, edits and digest of ``rows`` (conv, known, turn, role, text, copies) for each conversation of ``df``."""
    known = cut(turns(rows))
    found = counted(known).join(rebuilt(rows, blocks(known)), "conv")
    every = df.groupBy(conversation().alias("conv")).agg(F.max(F.col("conv_id").cast("long")).alias("conv_id"))
    out = every.join(found, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
