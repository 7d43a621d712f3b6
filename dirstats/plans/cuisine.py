"""Questions about cuisines: dominance per location, popularity against quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numeric import percent, ratio, round_half_up
from ..operators import sums as M
from ..operators.cumulative import with_ranks
from ..schema import FIELDS, Fields


def _dominant(entities: DataFrame) -> DataFrame:
    """Most frequent cuisine per location, ties by cuisine name.

    The winner is the least (-count, cuisine) struct, an aggregate combined on
    the map side together with the location total; a location holding a third
    of all rows costs no more than any other.
    """
    cells = M.group_sums(entities, ["location", "primary_cuisine"])
    candidate = F.struct(
        (-F.col("_n")).alias("_rank"),
        "primary_cuisine",
        M.avg_rating().alias("avg_rating"),
    )
    return (
        cells.groupBy("location")
        .agg(F.min(candidate).alias("_top"), F.sum("_n").alias("total_restaurants"))
        .select(
            "location",
            F.col("_top.primary_cuisine").alias("dominant_cuisine"),
            (-F.col("_top._rank")).alias("dominant_cuisine_count"),
            "total_restaurants",
            F.col("_top.avg_rating").alias("cuisine_avg_rating"),
        )
    )


def dominant_per_location(entities: DataFrame, *, top: int = 20) -> DataFrame:
    return (
        _dominant(entities)
        .select(
            "location",
            "dominant_cuisine",
            "dominant_cuisine_count",
            "total_restaurants",
            percent(F.col("dominant_cuisine_count"), F.col("total_restaurants")).alias(
                "cuisine_share_pct"
            ),
            "cuisine_avg_rating",
        )
        .orderBy(F.desc("total_restaurants"), "location")
        .limit(top)
    )


def dominance_summary(entities: DataFrame, *, top: int = 10) -> DataFrame:
    """Locations won per cuisine, as a share of all locations."""
    wins = (
        _dominant(entities)
        .groupBy("dominant_cuisine")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("dominant_cuisine_count").alias("total_restaurants_as_dominant"),
        )
    )
    return (
        M.with_platform(wins, "_n")
        .select(
            "dominant_cuisine",
            F.col("_n").alias("locations_dominated"),
            M.share("_n", "_all_n").alias("pct_of_all_locations"),
            "total_restaurants_as_dominant",
            round_half_up(ratio(F.col("total_restaurants_as_dominant"), F.col("_n")), 0).alias(
                "avg_count_per_location"
            ),
        )
        .orderBy(F.desc("locations_dominated"), "dominant_cuisine")
        .limit(top)
    )


def cuisine_stats(
    entities: DataFrame, *, min_rows: int = 50, fields: Fields = FIELDS
) -> DataFrame:
    """Both ranks and all metrics for every cuisine with enough entities.

    Ranks are taken over ranges of the cuisines' counts and ratings.
    """
    sums = M.group_sums(entities, ["primary_cuisine"], fields=fields)
    platform = M.with_platform(sums, "_rate", "_rated")
    measured = platform.filter(F.col("_n") >= min_rows).select(
        "primary_cuisine",
        M.n_rows().alias("total_count"),
        F.col("_rated").alias("rated_count"),
        M.avg_rating().alias("avg_rating"),
        round_half_up(M.avg_rating() - M.mean_rate("_all"), 2).alias("vs_platform_avg"),
        M.avg_cost().alias("avg_cost"),
        M.avg_votes().alias("avg_votes"),
        M.quality_score().alias("quality_score_pct"),
        M.online_pct().alias("online_order_pct"),
        M.unrated_pct().alias("unrated_pct"),
        M.performance_index().alias("performance_index"),
    )
    tier = L.at_least(F.col("avg_rating"), L.PERFORMANCE_TIERS, L.PERFORMANCE_ELSE)
    ranks = {"popularity_rank": ("total_count", True), "quality_rank": ("avg_rating", True)}
    return with_ranks(measured, ranks).withColumn("performance_tier", tier)


def popularity(entities: DataFrame, *, min_rows: int = 50, top: int = 15) -> DataFrame:
    stats = cuisine_stats(entities, min_rows=min_rows)
    return (
        stats.select(
            "popularity_rank",
            "quality_rank",
            "primary_cuisine",
            "total_count",
            "rated_count",
            "avg_rating",
            "vs_platform_avg",
            "avg_cost",
            "avg_votes",
            "quality_score_pct",
            "online_order_pct",
            "unrated_pct",
            "performance_index",
            "performance_tier",
        )
        .orderBy(F.desc("total_count"), "primary_cuisine")
        .limit(top)
    )


def quality(entities: DataFrame, *, min_rows: int = 50, top: int = 15) -> DataFrame:
    stats = cuisine_stats(entities, min_rows=min_rows)
    return (
        stats.select(
            "quality_rank",
            "popularity_rank",
            "primary_cuisine",
            "total_count",
            "avg_rating",
            "vs_platform_avg",
            "avg_cost",
            "avg_votes",
            "quality_score_pct",
            "online_order_pct",
            "performance_index",
            "performance_tier",
        )
        .orderBy(F.desc_nulls_last("avg_rating"), "primary_cuisine")
        .limit(top)
    )


def rank_gap(entities: DataFrame, *, min_rows: int = 50) -> DataFrame:
    """Popularity rank minus quality rank: negative is overrated."""
    gap = F.col("popularity_rank") - F.col("quality_rank")
    return (
        cuisine_stats(entities, min_rows=min_rows)
        .select(
            "primary_cuisine",
            "total_count",
            "avg_rating",
            "popularity_rank",
            "quality_rank",
            gap.alias("rank_gap"),
        )
        .orderBy(F.desc("rank_gap"), "primary_cuisine")
    )
