"""Join shapes used across the package. Physical strategy is left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import write_stage


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which a null key matches a null key; keys appear once.

    Planned as an ordinary hash or sort-merge join, so AQE can split a hot key
    of the left side. For ``how="full"`` keys are taken from whichever side has
    the row.
    """
    hidden = {key: f"_right_{key}" for key in keys}
    other = right.withColumnsRenamed(hidden)
    condition = reduce(and_, [left[key].eqNullSafe(other[hidden[key]]) for key in keys])
    joined = left.join(other, condition, how)
    if how == "full":
        joined = joined.withColumns(
            {key: F.coalesce(F.col(key), F.col(hidden[key])) for key in keys}
        )
    return joined.drop(*hidden.values())


def literal_frame(
    spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[object]]
) -> DataFrame:
    """A handful of constant rows, made on the JVM side with a size the planner knows."""
    cells = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))


def keys_with_at_least(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Keys that occur in at least ``min_rows`` rows; null is not a key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") >= min_rows).select(key)


def most_frequent_keys(df: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` most frequent non-null keys, ties by key; at most ``top`` rows."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), key).limit(top).select(key)


def keep_keys(df: DataFrame, keys: DataFrame, *, stage: bool = False) -> DataFrame:
    """Rows whose key is listed in ``keys``.

    Set ``stage`` when ``keys`` is computed and likely much smaller than its
    estimate: it is then written first, and the planner, seeing its true size,
    broadcasts it instead of shuffling all rows by a key that may be skewed.
    """
    if stage:
        keys = write_stage(keys, "keys")
    return df.join(keys, keys.columns, "left_semi")


def missing_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``df`` that ``dim`` does not have."""
    distinct = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return distinct.join(dim.select(key), key, "left_anti")
