"""Running sums, ranks with ties and exact medians without one task seeing all values.

A frame of distinct values is cut into ranges at points taken from its own quantiles. The cut
points are literals of the plan, so the range of a value is a function of the value: equal values
never span two ranges, and every branch of a plan, also one that is computed again, sees the same
ranges. A running sum is then the sum inside the range plus the sums of the ranges before, one
number per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import write_stage

#: Ranges at most; their sums meet in one task.
MOST_RANGES = 1_000


def cut_points(values: DataFrame, value: str, ranges: int | None = None) -> list:
    """At most ``ranges - 1`` points that part the values into ranges of about equal size."""
    if ranges is None:
        ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(ranges, MOST_RANGES)
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    found = values.agg(F.percentile_approx(value, shares, 100 * ranges).alias("cuts")).first().cuts
    return sorted(set(found or []))


def range_of(value: Column, cuts: Sequence) -> Column:
    """Number of the range of a value; nulls have a range of their own, the last one."""
    if not cuts:
        inside = F.lit(0)
    else:
        inside = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))
    return F.when(value.isNull(), F.lit(len(cuts) + 1)).otherwise(inside)


def running_sums(
    counts: DataFrame,
    value: str,
    weight: str,
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``_before``, the weight of all rows of the same group whose value comes earlier, and
    ``_whole``, the weight of the group.

    ``counts`` has one row per group and value and is read more than once: stage it if it is
    costly. Nulls come last. Values must be numbers.
    """
    cuts = cut_points(counts, value, ranges)
    number = range_of(F.col(value), cuts)
    last = len(cuts) + 1
    if descending:
        number = F.when(F.col(value).isNull(), F.lit(last)).otherwise(F.lit(last - 1) - number)
    ranged = counts.withColumn("_range", number)
    groups = [f"_by{i}" for i in range(len(by))]
    named = [F.col(b).alias(g) for b, g in zip(by, groups, strict=True)]
    sums = ranged.groupBy(*named, F.col("_range").alias("_at")).agg(F.sum(weight).alias("_sum"))
    earlier = W.partitionBy(*groups).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *groups,
        "_at",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(W.partitionBy(*groups)).alias("_whole"),
    )
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    inside = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_at")
    for b, g in zip(by, groups, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(g))
    return (
        summed.join(offsets, same)
        .withColumn("_before", F.col("_offset") + F.col("_inside"))
        .drop(*groups, "_at", "_offset", "_inside", "_range")
    )


def value_counts_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group and value, nulls left out, written once: ``_n`` of each."""
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    return write_stage(counted, "value-counts")


def exact_medians(
    counts: DataFrame, value: str, weight: str = "_n", *, by: Sequence[str] = (), out: str = "median"
) -> DataFrame:
    """One row per group with the interpolated median of its values, from (group, value, weight).

    Selection by position: of all values only the one or two in the middle of a group leave
    their range. Null values do not count; a group without others has no row, and without groups
    there is one row, null if there is no value.
    """
    placed = running_sums(counts.filter(F.col(value).isNotNull()), value, weight, by=by)
    first = F.floor((F.col("_whole") - 1) / 2)
    second = F.floor(F.col("_whole") / 2)

    def at(position: Column) -> Column:
        here = (F.col("_before") <= position) & (position < F.col("_before") + F.col(weight))
        return F.when(here, F.col(value).cast("double"))

    middle = placed.select(*by, at(first).alias("_low"), at(second).alias("_high"))
    middle = middle.filter(F.col("_low").isNotNull() | F.col("_high").isNotNull())
    found = middle.groupBy(*by).agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    between = F.col("_low") * 0.5 + F.col("_high") * 0.5
    return found.select(
        *by, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias(out)
    )


def with_ranks(df: DataFrame, ranks: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add RANK columns: name -> (value column, descending), nulls last and tied with each other.

    Ranks are worked out per distinct value and joined back, so a value that many rows share is
    one row while it is placed, and a join that can be split when it is attached. ``df`` is
    staged first, as every rank reads it.
    """
    df = write_stage(df, "ranked")
    for out, (value, descending) in ranks.items():
        values = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        placed = running_sums(values, "_value", "_n", descending=descending)
        ranked = placed.select("_value", (F.col("_before") + 1).cast("bigint").alias(out))
        df = df.join(ranked, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")
    return df
