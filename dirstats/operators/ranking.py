"""Ranks, buckets and percentiles, with the plan each needs at scale."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import exact, percent, ratio
from ..sources.staging import write_stage
from .cumulative import running_sums, value_counts_of

# monotonically_increasing_id puts the partition number above this many bits.
_ROW_BITS = 33


def top_ranked(
    df: DataFrame, order: Column, ties: Sequence[Column], top: int, out: str
) -> DataFrame:
    """The first ``top`` rows with their RANK by ``order``.

    A rank depends only on the rows above, so cutting first (a distributed
    top-k) and ranking the few survivors gives the same numbers.
    """
    first = df.orderBy(order, *ties).limit(top)
    return first.withColumn(out, F.rank().over(W.orderBy(order)).cast("bigint"))


def ntile_of(row: Column, total: Column, buckets: int) -> Column:
    """NTILE bucket of row number ``row`` out of ``total``."""
    size = F.floor(total / buckets)
    longer = total % buckets
    in_longer = longer * (size + 1)
    return F.when(
        row <= in_longer, F.floor((row - 1) / (size + 1)) + 1
    ).otherwise(longer + F.floor(F.try_divide(row - 1 - in_longer, size)) + 1).cast("bigint")


def stage_in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition, sort, and write with ``_part`` and ``_pos``, the place of each row.

    Written once, so that partition sizes and positions read later come from the
    same run even if executors are lost in between.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = (
        ranged.withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id")
    )
    return write_stage(placed, "ranged")


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``_row``, the global row number, and ``_total``, the number of rows.

    A row's number is its position plus the sizes of the partitions before its
    own. Offsets are one row per partition, few enough to broadcast.
    """
    staged = stage_in_order(df, order)
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(W.partitionBy()).alias("_total"),
    )
    return (
        staged.join(F.broadcast(offsets), "_part")
        .withColumn("_row", F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """ROW_NUMBER over the whole frame without one task seeing all rows.

    End ``order`` with a unique tie-break, so that a sort value shared by many
    rows can be split over partitions and every run numbers rows alike.
    """
    return _numbered(df, order).drop("_total").withColumnRenamed("_row", out)


def global_ntile(
    df: DataFrame, order: Sequence[Column], buckets: int, out: str = "ntile"
) -> DataFrame:
    """NTILE over the whole frame, from the global row number and the row count."""
    bucket = ntile_of(F.col("_row"), F.col("_total"), buckets)
    return _numbered(df, order).withColumn(out, bucket).drop("_row", "_total")


def share_below(
    df: DataFrame, value: str = "rate", out: str = "beats_pct", digits: int = 1
) -> DataFrame:
    """Per distinct value: percent of all non-null rows that are strictly lower.

    Works on a staged value histogram whose running sum is taken by ranges, so it
    suits free-form doubles as well as a handful of ratings.
    """
    counts = value_counts_of(df.select(F.col(value).alias("_units")), "_units")
    below = running_sums(counts, "_units", "_n")
    return below.select("_units", percent(F.col("_before"), F.col("_whole"), digits).alias(out))


def with_share_below(
    df: DataFrame,
    population: DataFrame,
    value: str = "rate",
    out: str = "beats_pct",
    *,
    stage: bool = False,
) -> DataFrame:
    """Attach :func:`share_below` of ``population`` to each row; null stays null.

    Set ``stage`` when ``df`` is large: the histogram is then written first, and
    the planner, seeing its true size, broadcasts it instead of shuffling all
    rows by a handful of ratings.
    """
    shares = share_below(population, value, out)
    if stage:
        shares = write_stage(shares, "shares")
    keyed = df.withColumn("_units", F.col(value))
    return keyed.join(shares, "_units", "left").drop("_units")


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Equal-width histogram over min..max with every bin listed, the last one closed.

    Two scans of one column: the bounds, as a scalar subquery, then the rows per bin, of which
    each task sends one per bin. A row's bin is guessed in doubles and put right by comparing
    exact decimals with the bin's edges. A column with a single value gets a range of 1 around
    it, and one without values no bins.
    """
    half = F.lit(Decimal("0.5"))
    rows = df.select(exact(F.col(value)).alias("_units")).filter(F.col("_units").isNotNull())
    ends = rows.agg(F.min("_units").alias("low"), F.max("_units").alias("high")).filter(
        F.col("low").isNotNull()
    )
    flat = F.col("low") == F.col("high")
    widened = ends.select(
        F.when(flat, F.col("low") - half).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + half).otherwise(F.col("high")).alias("high"),
    )
    bounds = widened.agg(F.max(F.struct("low", "high"))).scalar()
    bounded = rows.withColumn("_ends", bounds).select(
        "_units", F.col("_ends.low").alias("_low"), F.col("_ends.high").alias("_high")
    )
    span = F.col("_high") - F.col("_low")
    along = (F.col("_units") - F.col("_low")) * bins
    guess = F.floor(F.try_divide(along.cast("double"), span.cast("double"))).cast("bigint")
    guessed = bounded.withColumn("_guess", F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1)))
    fixed = (
        F.when(along < span * F.col("_guess"), F.col("_guess") - 1)
        .when(along >= span * (F.col("_guess") + 1), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    counted = guessed.groupBy(F.least(fixed, F.lit(bins - 1)).cast("bigint").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    listed = widened.select(
        "low", "high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("_at")
    )
    width = F.col("high") - F.col("low")

    def edge(step: Column) -> Column:
        return ratio((F.col("low") * bins + width * step) * 10**4, F.lit(bins * 10**4))

    return listed.join(counted, F.col("_at") == F.col("_bin"), "left").select(
        (F.col("_at") + 1).alias("bin"),
        edge(F.col("_at")).alias("bin_from"),
        edge(F.col("_at") + 1).alias("bin_to"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("row_count"),
    )
