"""Grouping many rows by keys of which a few may be very common.

Combining on the map side keeps a common key from gathering in one task, but where most keys
are rare it only makes every task hold and sort what it reads. So the rows are counted per hash
bucket of their key first: those of crowded buckets are combined on the map side, all others are
shuffled by key as they are and meet in tasks of a bounded number of rows. The bucket follows
from the key alone, so the rows of a key stay together whatever was counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hash buckets that are counted, and rows that a task should and may hold.
BUCKETS = 1 << 16
TASK_ROWS, MOST_TASK_ROWS = 250_000, 2_000_000

# Up to so many partitions Spark writes shuffled rows straight to their files; beyond, a task
# keeps all its rows until they are sorted by partition.
STREAMED = 200


def split_crowded(
    df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of crowded buckets as they lie, and the others shuffled by key; None for no rows.

    A bucket is crowded if it has more rows than a task's share. A table that fits one task
    is crowded as a whole. ``df`` is read once for the counts, of which only those of large
    buckets reach the driver.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    large = F.when(F.col("_n") > task_rows, F.struct("_bucket", "_n"))
    found = counts.agg(F.sum("_n").alias("total"), F.collect_list(large).alias("large")).first()
    total = found.total or 0
    if total <= task_rows:
        return df, None
    parts = max(min(STREAMED, -(-total // task_rows)), -(-total // MOST_TASK_ROWS))
    crowded = [r._bucket for r in found.large if r._n * parts > total]
    rest = df.filter(~bucket.isin(crowded)) if crowded else df
    shuffled = rest.repartition(parts, *[F.col(f"`{k}`") for k in keys])
    return (df.filter(bucket.isin(crowded)) if crowded else None), shuffled


def grouped(
    df: DataFrame,
    keys: Sequence[str],
    gather: Callable[[DataFrame], DataFrame],
    combine: Callable[[DataFrame], DataFrame] | None = None,
    *,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``gather`` of the rows that are shuffled by key together with ``combine`` of the crowded.

    Both work per key and give the same rows; ``gather`` needs no further shuffle for that.
    """
    crowded, rest = split_crowded(df, keys, task_rows)
    if crowded is None:
        return gather(rest)
    combined = (combine or gather)(crowded)
    return combined if rest is None else combined.unionByName(gather(rest))
