"""Recurring payments: detection, decisions, summary, incremental recompute.

A series is a group of posted outflows with one normalized description and currency, three
members at least, whose mean gap lies in a cadence's band. The mean gap of sorted dates is
(last - first) / (members - 1), so no window is needed. The median is the upper one; it
is taken from counts by amount, so a series never gathers its members in one row, and a
large one not even its amounts in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.functions import money, text

DETECTOR = "recurring-v1"
#: Cadence, lowest and highest mean gap in days, days to the next payment.
CADENCES = (("weekly", 5, 9, 7), ("biweekly", 11, 17, 14), ("monthly", 26, 35, 30), ("quarterly", 80, 100, 91), ("yearly", 340, 390, 365))


def eligible(ledger: DataFrame, excluded_ids: DataFrame | None = None) -> DataFrame:
    """Posted outflows with their series' key."""
    rows = ledger.filter((F.col("status") == "posted") & money.is_outflow(F.col("amount")))
    if excluded_ids is not None:
        rows = rows.join(excluded_ids.select("txn_id"), "txn_id", "left_anti")
    return rows.withColumn("name", text.normalize_recurring(F.col("description")))


def cadence_of(days: Column, gaps: Column) -> Column:
    """Cadence of a series by whole numbers: days / gaps in a band."""
    out = None
    for name, low, high, _ in CADENCES:
        hit = (days >= low * gaps) & (days <= high * gaps)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("irregular")


#: Members from which on a series' amounts are dealt to bins, and how many bins; the bins say how even the work is, not what the result is.
LARGE, BINS = 1 << 17, 1024


def upper_medians(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The upper median of ``value`` in each group: sorted[n // 2]. Equal values are counted first, and a running count finds the middle."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("members"), F.min(value).alias("least"), F.max(value).alias("most"))
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("c"))
    return medians_of(lambda some: counts.join(sizes.filter(some), key), key, value)


def medians_of(counts: Callable[[Column], DataFrame], key: list[str], value: str) -> DataFrame:
    """``key`` and median from counts of equal values (c), each with its group's members, least and most; ``counts`` gives those of the groups for which a condition on these holds.

    A group is sorted in one task, unless it has more than LARGE members: then bins of equal
    width between its least and most value are counted, and only the bin that holds the middle
    is sorted. Small groups pay for no more than one sort.
    """
    w, middle = Window.partitionBy(*key), F.floor(F.col("members") / 2)
    middles = lambda df: df.filter((F.col("upto") > middle) & (F.col("upto") - F.col("c") <= middle)).select(*key, F.col(value).alias("median"))
    small = middles(counts(F.col("members") <= LARGE).withColumn("upto", F.sum("c").over(w.orderBy(value))))
    many = counts(F.col("members") > LARGE)
    width = (F.col("most") - F.col("least")).cast("double")
    binned = many.withColumn("bin", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("least")).cast("double") / width * BINS), F.lit(BINS - 1))).otherwise(0).cast("int"))
    bins = binned.groupBy(*key, "bin").agg(F.sum("c").alias("in_bin"), F.first("members").alias("members"))
    upto = F.sum("in_bin").over(w.orderBy("bin"))  # BINS rows a group at most
    hit = bins.withColumn("before", upto - F.col("in_bin")).filter((F.col("before") <= middle) & (F.col("before") + F.col("in_bin") > middle)).select(*key, "bin", "before")
    large = middles(binned.join(hit, [*key, "bin"]).withColumn("upto", F.col("before") + F.sum("c").over(w.orderBy(value))))
    return small.unionByName(large)


def totals(rows: DataFrame) -> DataFrame:
    """members, first_seen, last_seen, least and most of each series of eligible rows; such totals can be merged."""
    return rows.groupBy("name", "currency").agg(F.count("*").cast("long").alias("members"), F.min("posted_date").alias("first_seen"), F.max("posted_date").alias("last_seen"), F.min("size").cast(money.TOTAL).alias("least"), F.max("size").cast(money.TOTAL).alias("most"))


def regular(groups: DataFrame) -> DataFrame:
    """Those of ``totals`` that are a series, with their cadence."""
    return groups.filter("members >= 3").withColumn("cadence", cadence_of(F.datediff("last_seen", "first_seen"), F.col("members") - 1)).filter("cadence <> 'irregular'")


def described(series: DataFrame, medians: DataFrame) -> DataFrame:
    """Proposals from ``regular`` series and their medians."""
    step = F.element_at(F.create_map(*[F.lit(x) for name, _, _, days in CADENCES for x in (name, days)]), F.col("cadence"))
    variable = F.col("least") != F.col("most")
    return series.join(medians, ["name", "currency"]).select(
        signature(F.col("name"), F.col("currency"), F.col("cadence")).alias("signature"), "name", "currency", "cadence", "members", "first_seen", "last_seen",
        F.date_add("last_seen", step).alias("next_expected"), "least", "most", F.col("median").cast(money.TOTAL).alias("median"), variable.alias("is_variable"), F.when(variable, 0.85).otherwise(0.95).alias("confidence"),
    )


def proposals(ledger: DataFrame, excluded_ids: DataFrame | None = None) -> DataFrame:
    """signature, name, currency, cadence, members, first_seen, last_seen, next_expected, least, most, median, is_variable and confidence of each series."""
    rows = eligible(ledger, excluded_ids).withColumn("size", F.abs("amount"))
    series = regular(totals(rows))
    key, size = ["name", "currency"], ["members", "least", "most"]
    counts = lambda some: rows.select(*key, "size").join(series.filter(some).select(*key, *size), key).groupBy(*key, "size").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in size])
    return described(series, medians_of(counts, key, "size"))


def found(ledger: DataFrame, excluded_ids: DataFrame | None = None) -> DataFrame:
    """signature, name, currency, cadence, members, first_seen and last_seen of each series: ``proposals`` without what amounts say."""
    groups = eligible(ledger, excluded_ids).groupBy("name", "currency").agg(F.count("*").cast("long").alias("members"), F.min("posted_date").alias("first_seen"), F.max("posted_date").alias("last_seen"))
    return regular(groups).select(signature(F.col("name"), F.col("currency"), F.col("cadence")).alias("signature"), "name", "currency", "cadence", "members", "first_seen", "last_seen")


def signature(name: Column, currency: Column, cadence: Column) -> Column:
    """The key of a series holds the currency once in small letters, and the signature adds it again."""
    return F.concat_ws(":", F.lower(F.concat_ws(":", name, currency)), currency, cadence)


def members(ledger: DataFrame, found: DataFrame, excluded_ids: DataFrame | None = None) -> DataFrame:
    """signature and txn_id of the members of the series in ``found``."""
    return eligible(ledger, excluded_ids).join(found.select("name", "currency", "signature"), ["name", "currency"]).select("signature", "txn_id")


def gaps(ledger: DataFrame) -> DataFrame:
    """name, currency, posted_date and days since the date before in the series, for each distinct date."""
    days = eligible(ledger).select("name", "currency", "posted_date").distinct()
    w = Window.partitionBy("name", "currency").orderBy("posted_date")
    return days.withColumn("gap", F.datediff("posted_date", F.lag("posted_date").over(w)))


def recompute(ledger: DataFrame, previous: DataFrame, affected_ids: DataFrame) -> DataFrame:
    """``proposals`` of the whole ledger from ``previous`` ones: only the groups of the affected transactions are detected anew."""
    touched = ledger.join(affected_ids.select("txn_id"), "txn_id", "left_semi").select(text.normalize_recurring(F.col("description")).alias("name"), "currency").distinct()
    key = ["name", "currency"]
    fresh = proposals(ledger.withColumn("name", text.normalize_recurring(F.col("description"))).join(touched, key, "left_semi").drop("name"))
    return previous.join(touched, key, "left_anti").unionByName(fresh)


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision on each signature (by ordinal)."""
    return decisions.groupBy("signature").agg(F.max(F.struct("ordinal", "status")).alias("d")).select("signature", F.col("d.status").alias("decided"))


def with_status(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with status: confirmed, dismissed or muted as decided, else proposed."""
    decided = F.col("decided").isin("confirmed", "dismissed", "muted")
    return found.join(latest(decisions), "signature", "left").withColumn("status", F.when(decided, F.col("decided")).otherwise("proposed")).drop("decided")


def unresolved(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals without a resolving decision."""
    return found.join(decisions.filter("status in ('confirmed', 'dismissed', 'muted', 'superseded')").select("signature"), "signature", "left_anti")


def summary(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """By currency: counts by status, and the sum of confirmed medians, whatever their cadence."""
    rows = with_status(found, decisions)
    n = lambda s: money.count_if(F.col("status") == s).alias(f"n_{s}")
    return rows.groupBy("currency").agg(money.total(F.col("median"), F.col("status") == "confirmed").alias("confirmed_spend"), n("confirmed"), n("proposed"), n("dismissed"), n("muted"), F.count("*").cast("long").alias("n_series"))


def stale(decisions: DataFrame, decision_members: DataFrame, ledger: DataFrame, detector: str = DETECTOR) -> DataFrame:
    """Confirmed decisions of this kind of detector that another version made or that have a member that is not posted. decision_members: decision_id, txn_id."""
    own = decisions.filter("status = 'confirmed' and detector_version like 'recurring-%'")
    posted = ledger.filter("status = 'posted'").select("txn_id", F.lit(True).alias("posted"))
    lost = decision_members.join(posted, "txn_id", "left").filter("posted is null").select("decision_id").distinct().withColumn("lost", F.lit(True))
    return own.join(lost, "decision_id", "left").filter(F.col("lost") | (F.col("detector_version") != detector)).drop("lost")


def merge_members(decision_members: DataFrame, decision_ids: list) -> DataFrame:
    """The union of the members of several decisions."""
    return decision_members.filter(F.col("decision_id").isin(*decision_ids)).select("txn_id").distinct()


def is_partition(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """One row, ``exact``: whether ``parts`` (part, txn_id) hold each member of ``whole`` (txn_id) exactly once."""
    dealt = parts.groupBy("txn_id").agg(F.count("*").alias("times"))
    both = whole.select("txn_id").distinct().withColumn("w", F.lit(True)).join(dealt, "txn_id", "full")
    return both.agg((F.count_if(F.col("w").isNull() | F.col("times").isNull() | (F.col("times") > 1)) == 0).alias("exact"))
