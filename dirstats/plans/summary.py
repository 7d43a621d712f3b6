"""Headline statements over the entity table, and the KPI snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (
    distinct_count,
    exact_mean,
    percent,
    round_half_up,
)
from ..operators import sums as M
from ..operators.profile import value_range, value_shares

def total_rows(entities: DataFrame, out: str = "total_restaurants") -> DataFrame:
    return entities.agg(F.count(F.lit(1)).alias(out))


def distinct_values(
    entities: DataFrame, column: str, out: str, approx: bool = False
) -> DataFrame:
    return entities.agg(distinct_count(F.col(column), approx).alias(out))


def rating_range(entities: DataFrame) -> DataFrame:
    rate = F.col("rate")
    return entities.filter(rate.isNotNull()).agg(
        F.min(rate).alias("min_rate"),
        F.max(rate).alias("max_rate"),
        round_half_up(exact_mean(rate, whole=False), 2).alias("avg_rate"),
        F.count(F.lit(1)).alias("rated_count"),
    )


def unrated(entities: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("rate").isNull())
    return entities.agg(
        missing.alias("unrated_count"),
        percent(missing, F.count(F.lit(1))).alias("pct_of_total"),
    )


def cost_range(entities: DataFrame, approx: bool = False) -> DataFrame:
    """Range, mean and median; the median is exact unless ``approx``."""
    return value_range(entities, "approx_cost", approx=approx).select(
        F.col("low").alias("min_cost"),
        F.col("high").alias("max_cost"),
        round_half_up(F.col("mean"), 0).alias("avg_cost"),
        F.col("median").alias("median_cost"),
    )


def votes_range(entities: DataFrame) -> DataFrame:
    votes = F.col("votes")
    return entities.agg(
        F.min(votes).alias("min_votes"),
        F.max(votes).alias("max_votes"),
        round_half_up(exact_mean(votes), 0).alias("avg_votes"),
    )


def adoption(entities: DataFrame, flag: str, name: str) -> DataFrame:
    """Rows with and without a 0/1 flag, and the share with it."""
    having = F.sum(F.col(flag).cast("bigint"))
    total = F.count(F.lit(1))
    return entities.agg(
        having.alias(f"with_{name}"),
        (total - having).alias(f"without_{name}"),
        percent(having, total).alias(f"pct_with_{name}"),
    )


def distribution(entities: DataFrame, column: str) -> DataFrame:
    """Rows and share of the whole table per label, largest first."""
    return (
        value_shares(entities, column)
        .withColumnRenamed("row_count", "restaurant_count")
        .orderBy(F.desc("restaurant_count"), F.col(column).asc_nulls_last())
    )


def kpi_snapshot(entities: DataFrame) -> DataFrame:
    """Eight headline numbers in one pass.

    Sums per (location, cuisine) first; both distinct counts then run on that
    small frame instead of expanding every base row once per distinct column.
    """
    groups = M.group_sums(entities, ["location", "primary_cuisine"])
    totals = groups.agg(
        *M.merged_columns(),
        F.count_distinct("location").alias("unique_locations"),
        F.count_distinct("primary_cuisine").alias("unique_cuisines"),
    )
    return totals.select(
        M.n_rows().alias("total_restaurants"),
        M.avg_rating().alias("avg_rating"),
        M.avg_cost().alias("avg_cost"),
        M.online_pct().alias("online_order_pct"),
        M.booking_pct().alias("book_table_pct"),
        M.unrated_pct().alias("unrated_pct"),
        "unique_locations",
        "unique_cuisines",
    )
