"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once on every text and stores the measurements and
one failure bit a rule. ``apply_policy`` reads only the bits: a policy is a named,
versioned mask of the rules that reject. ``ablation`` says, in one bitwise
aggregation, what each rule rejects alone and together with others.

A word is a run of characters other than space and U+0009..U+000D. Defined
results: a null text has no words (it fails ``few_words``); ties do not arise;
equal rows get equal rows; an empty table gives an empty ledger; further columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import documents

SYMBOLS = "[#*$%&|<>]+"

#: Bit by rule. Bits never change their meaning; new rules take new bits.
RULES = {"few_words": 0, "repeated_windows": 1, "symbol_heavy": 2, "duplicate_lines": 3, "long_words": 4}

#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "standard-1": ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[policy])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: optimizers would otherwise copy it into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more among ``words``: windows are sorted by hash, neighbours compared, and the marked windows' cover counted."""

    def marked(s: Column) -> Column:
        last = F.size(s) - 1
        twice = lambda i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == s[i]["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == s[i]["h"]))
        kept = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(twice(i), s[i]["at"])), lambda x: x.isNotNull())
        return bound(F.sort_array(kept), cover)

    def cover(at: Column) -> Column:
        step = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.least(F.lit(3), at[i] - at[i - 1]))
        return F.when(F.size(at) == 0, F.lit(0)).when(F.size(at) == 1, F.lit(3)).otherwise(F.aggregate(step, F.lit(0), lambda a, x: a + x) + 3)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("at")))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound(F.sort_array(windows), marked)).cast("long")


def measurements(text: Column) -> Column:
    """A struct of the measurements of ``text``."""
    per_words = bound(
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    per_lines = bound(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    n_symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return bound(
        F.struct(per_words.alias("w"), per_lines.alias("l"), n_symbols.alias("n_symbols")),
        lambda m: F.struct(
            *[m["w"][c].alias(c) for c in ("n_words", "word_chars")], m["n_symbols"].alias("n_symbols"), *[m["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")], m["w"]["n_repeat_words"].alias("n_repeat_words")
        ),
    )


def failures(m: Column) -> dict[str, Column]:
    """Each rule's condition over the measurements; integers only, so that any engine agrees."""
    return {
        "few_words": m["n_words"] < 50,
        "repeated_windows": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbol_heavy": 100 * m["n_symbols"] > 10 * m["word_chars"],
        "duplicate_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        "long_words": m["word_chars"] > 20 * m["n_words"],
    }


def failed_bits(m: Column) -> Column:
    """A bit of RULES for each rule that the measurements fail."""
    total = F.lit(0)
    for name, condition in failures(m).items():
        total = total.bitwiseOR(F.when(condition, F.lit(1 << RULES[name])).otherwise(F.lit(0)))
    return total.cast("long")


def ledger(df: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits``, a row for each row of ``df``."""
    rows = documents(df).select("doc_id", bound(measurements(F.col("text")), lambda m: F.struct(m.alias("m"), failed_bits(m).alias("bits"))).alias("x"))
    return rows.select("doc_id", "x.m.*", F.col("x.bits").alias("failed_bits"))


def keep(df: DataFrame, policy: str = "standard-1") -> DataFrame:
    """The rows of ``df`` whose text the policy keeps, with all their columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.filter(bound(measurements(text), failed_bits).bitwiseAND(F.lit(mask(policy))) == 0)


def apply_policy(ledger_df: DataFrame, policy: str = "standard-1") -> DataFrame:
    """base_failed, kept and the policy's name, from the bits alone."""
    hit = lambda p: F.col("failed_bits").bitwiseAND(F.lit(mask(p))) != 0
    return ledger_df.withColumns({"base_failed": hit("base-1"), "kept": ~hit(policy), "policy": F.lit(policy)})


def ablation(ledger_df: DataFrame, policy: str = "standard-1") -> DataFrame:
    """A row for each rule of the policy: documents it rejects, those it alone rejects, and documents kept without it. Equal bit patterns are counted first, so the second step sees at most 2^rules rows."""
    patterns = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(hit).alias("n_rejected"), count(hit & (rest == 0)).alias("n_only_this"), count(rest == 0).alias("n_kept_without"))


#: DuckDB's form of the measurements, for a relation ``docs(doc_id, text)``; ``ledger_sql`` wraps it.
_MEASURES = r"""
words AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM src),
triples AS (SELECT rid, unnest(range(1, len(w) - 1)) AS pos, w FROM words WHERE len(w) >= 3),
grams AS (SELECT rid, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS g FROM triples),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, pos + d AS word FROM twice, (SELECT unnest([0, 1, 2]) AS d)) GROUP BY rid),
rows_ AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
measures AS (SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM words JOIN rows_ USING (rid) LEFT JOIN cover USING (rid)),
rules AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failed_bits FROM measures)"""

LEDGER_SQL = (
    "WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)," + _MEASURES + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 31) = 0 AS kept, failed_bits FROM rules"""
)
