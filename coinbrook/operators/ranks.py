"""The value at a rank of each of a few large groups, exact, with no group in one task.

A window over a group would sort all its values in one task. Here a group's distinct
values are dealt to bins between splitters, rows are counted by bin, and only the bin
that holds the rank is sorted. Splitters come from a sketch: they say how even the bins
are, not what the result is. Many small groups are better served by a window alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splitters of a group. The bin that is sorted holds about one in so many of its distinct values.
SPLITTERS = 64


def value_at(rows: DataFrame, key: list[str], value: str, rank: Callable[[Column], Column], name: str) -> DataFrame:
    """``key`` and ``name``, sorted[rank(n)] of each group of n rows; nulls sort first, groups of a null key count too."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("c"))
    quantiles = [i / (SPLITTERS + 1) for i in range(1, SPLITTERS + 1)]
    splits = counts.groupBy(*key).agg(F.percentile_approx(value, quantiles, 4 * SPLITTERS).alias("splitters"))
    below = F.size(F.filter(F.array_distinct("splitters"), lambda s: s < F.col(value)))
    binned = _joined(counts, splits, key).withColumn("bin", F.coalesce(below, F.lit(0))).drop("splitters")
    order = Window.partitionBy(*key).orderBy("bin")  # SPLITTERS + 1 rows a group at most
    bins = binned.groupBy(*key, "bin").agg(F.sum("c").alias("in_bin")).withColumn("before", F.sum("in_bin").over(order) - F.col("in_bin"))
    bins = bins.withColumn("at", rank(F.sum("in_bin").over(Window.partitionBy(*key))))
    hit = bins.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("in_bin"))).drop("in_bin")
    running = _joined(binned, hit, [*key, "bin"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*key).orderBy(value)))
    return running.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at"))).select(*key, F.col(value).alias(name))


def _joined(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """An inner join on ``key`` in which nulls are equal."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = F.lit(True)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, on).drop(*[f"_{k}" for k in key])
