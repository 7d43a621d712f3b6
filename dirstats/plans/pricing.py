"""Questions about price: tier against tier, hidden gems, how rare gems are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores
from ..functions.numeric import exact, mean_of, percent, ratio, round_half_up
from ..operators import sums as M
from ..operators.ranking import global_ntile, ntile_of, top_ranked, with_share_below
from ..schema import FIELDS, Fields


def tier_performance(
    entities: DataFrame, by: str = "price_category", *, fields: Fields = FIELDS
) -> DataFrame:
    """Metrics per price tier and the jump from the tier below.

    Jumps difference the rounded averages. The windows see one row per tier.
    """
    order = L.ordinal(F.col(by), L.PRICE_TIERS)
    tiers = M.with_platform(M.group_sums(entities, [by], fields=fields), "_n", few=True).select(
        by,
        order.alias("_order"),
        M.n_rows().alias("total_restaurants"),
        M.share("_n", "_all_n").alias("market_share_pct"),
        M.avg_rating().alias("avg_rating"),
        M.avg_cost().alias("avg_cost"),
        M.avg_votes().alias("avg_votes"),
        M.quality_score().alias("quality_score_pct"),
        M.label_pct("Excellent").alias("excellent_pct"),
        M.label_pct("Poor").alias("poor_pct"),
        M.online_pct().alias("online_order_pct"),
        M.booking_pct().alias("book_table_pct"),
        M.unrated_pct().alias("unrated_pct"),
        M.value_score().alias("value_score"),
    )
    below = W.orderBy(F.col("_order").asc_nulls_last())

    def jump(metric: str, digits: int) -> Column:
        return round_half_up(F.col(metric) - F.lag(metric, 1).over(below), digits)

    jumps = tiers.withColumns(
        {
            "rating_jump_vs_prev": jump("avg_rating", 2),
            "cost_jump_vs_prev": jump("avg_cost", 0),
            "votes_jump_vs_prev": jump("avg_votes", 0),
        }
    )
    return jumps.orderBy(F.col("_order").asc_nulls_last()).select(
        by,
        "total_restaurants",
        "market_share_pct",
        "avg_rating",
        "rating_jump_vs_prev",
        "avg_cost",
        "cost_jump_vs_prev",
        "avg_votes",
        "votes_jump_vs_prev",
        "quality_score_pct",
        "excellent_pct",
        "poor_pct",
        "online_order_pct",
        "book_table_pct",
        "unrated_pct",
        "value_score",
        L.jump_verdict(F.col("_order") == 1, F.col("rating_jump_vs_prev")).alias(
            "price_jump_verdict"
        ),
    )


def _is_gem(tier: str, min_rate: float, min_votes: int) -> Column:
    return (
        (F.col("price_category") == tier)
        & (F.col("rate") >= min_rate)
        & (F.col("votes") >= min_votes)
    )


def hidden_gems(
    entities: DataFrame,
    *,
    tier: str = "Budget",
    min_rate: float = 4.0,
    min_votes: int = 100,
    buckets: int = 3,
    top: int = 15,
) -> DataFrame:
    """Cheap, well rated, proven entities by votes.

    The proof bucket is NTILE over the whole gem set. For the rows shown it
    follows from their position and the number of gems, so no task has to see
    all gems; the percentile comes from the rating histogram.
    """
    gems = entities.filter(_is_gem(tier, min_rate, min_votes))
    total = gems.agg(F.count(F.lit(1))).scalar()
    ties = [F.col("name"), F.col("location")]
    shown = top_ranked(gems, F.desc("votes"), ties, top, "gem_rank")
    position = F.row_number().over(W.orderBy(F.desc("votes"), *ties)).cast("bigint")
    placed = shown.withColumn("proof_bucket", ntile_of(position, total, buckets))
    return (
        with_share_below(placed, entities, "rate", "beats_pct_of_platform")
        .select(
            "gem_rank",
            "proof_bucket",
            "name",
            "location",
            "primary_cuisine",
            "rest_type",
            "rate",
            "votes",
            F.col("approx_cost").alias("cost_for_two"),
            scores.value_index(F.col("rate"), F.col("approx_cost")).alias("value_index"),
            "beats_pct_of_platform",
            "online_order",
            "book_table",
            L.at_least(F.col("rate"), L.GEM_TIERS, L.GEM_ELSE).alias("gem_tier"),
        )
        .orderBy(F.desc("votes"), "name", "location")
    )


def gem_proof_buckets(
    entities: DataFrame,
    *,
    tier: str = "Budget",
    min_rate: float = 4.0,
    min_votes: int = 100,
    buckets: int = 3,
) -> DataFrame:
    """NTILE by votes for every gem, not only the top of the list."""
    gems = entities.filter(_is_gem(tier, min_rate, min_votes)).select("name", "location", "votes")
    order = [F.desc("votes"), F.col("name"), F.col("location")]
    return global_ntile(gems, order, buckets, "proof_bucket")


def rating_percentiles(entities: DataFrame) -> DataFrame:
    """Percent of rated entities each rated entity beats."""
    rated = entities.filter(F.col("rate").isNotNull()).select("name", "location", "rate")
    return with_share_below(rated, entities, "rate", "beats_pct_of_platform", stage=True)


def gem_rarity(
    entities: DataFrame, *, tier: str = "Budget", min_rate: float = 4.0, min_votes: int = 100
) -> DataFrame:
    """Funnel from all entities of a tier to proven gems, one row."""
    rate, cost = F.col("rate"), F.col("approx_cost")
    well_rated = rate >= min_rate
    proven = well_rated & (F.col("votes") >= min_votes)
    total, rated = F.count(F.lit(1)), F.count(rate)
    gems = F.count_if(proven)
    gem_cost = F.sum(F.when(proven, cost.cast("bigint")))
    gem_rate = F.sum(F.when(proven, exact(rate)))
    return entities.filter(F.col("price_category") == tier).agg(
        total.alias("total_budget_restaurants"),
        rated.alias("rated_budget"),
        F.count_if(well_rated).alias("rated_4_plus"),
        percent(F.count_if(well_rated), rated).alias("pct_of_rated_budget"),
        gems.alias("proven_gems"),
        percent(gems, total).alias("pct_of_all_budget"),
        round_half_up(ratio(gem_cost, F.count(F.when(proven, cost))), 0).alias("gems_avg_cost"),
        round_half_up(mean_of(gem_rate, gems), 2).alias("gems_avg_rating"),
    )
