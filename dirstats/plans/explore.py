"""Exploration of the listing grain: the data behind every chart and printout.

All averages per key come from one aggregation by that key. Which keys to show
(the most frequent, the large ones) is then decided on the aggregated frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numeric import (
    distinct_count,
    exact,
    exact_mean,
    mean_of,
    percent,
    ratio,
    round_half_up,
)
from ..operators import sums as M
from ..operators.profile import (
    correlation_matrix,
    frequencies,
    in_label_order,
    target_correlations,
    value_range,
    value_shares,
)
from ..operators.ranking import histogram
from ..sources.staging import write_stage

NUMERIC_COLUMNS = ("online_order", "book_table", "rate", "votes", "approx_cost", "cuisine_count")
# Cleaning leaves no null in these.
COMPLETE_COLUMNS = ("online_order", "book_table", "approx_cost", "cuisine_count")


def raw_frequencies(raw: DataFrame) -> DataFrame:
    """Most frequent texts of the raw columns that need cleaning."""
    return frequencies(
        raw,
        {
            "rate": 30,
            "approx_cost(for two people)": 20,
            "online_order": None,
            "book_table": None,
            "listed_in(type)": None,
            "location": 20,
            "rest_type": 15,
            "cuisines": 15,
        },
    )


# Engineered features


def price_tier_stats(listings: DataFrame) -> DataFrame:
    cost = F.col("approx_cost")
    tiers = listings.groupBy("price_category").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(cost).alias("min_cost"),
        F.max(cost).alias("max_cost"),
        round_half_up(exact_mean(cost), 0).alias("avg_cost"),
    )
    total = F.sum("row_count").over(W.partitionBy())
    shares = tiers.withColumn("pct_of_total", percent(F.col("row_count"), total))
    return in_label_order(
        shares, "price_category", L.PRICE_TIERS, ["row_count", "pct_of_total"]
    ).select("price_category", "row_count", "pct_of_total", "min_cost", "max_cost", "avg_cost")


def rating_label_shares(listings: DataFrame) -> DataFrame:
    return in_label_order(
        value_shares(listings, "rating_label"),
        "rating_label",
        L.RATING_LABELS,
        ["row_count", "pct_of_total"],
    )


def _first_values(counts: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` most frequent non-null values.

    Null is sorted last and dropped after the cut: dropped before, it would be
    filtered under the aggregation, which could then not share its shuffle with
    the total over all rows.
    """
    order = F.col(column).isNull(), F.desc("row_count"), F.col(column)
    return counts.orderBy(*order).limit(top).filter(F.col(column).isNotNull())


def top_shares(listings: DataFrame, column: str, top: int) -> DataFrame:
    """Most frequent values with their percent of all rows."""
    return _first_values(value_shares(listings, column), column, top)


def cuisine_count_distribution(listings: DataFrame) -> DataFrame:
    return value_shares(listings, "cuisine_count", nulls=False).orderBy("cuisine_count")


def cuisine_feature_summary(listings: DataFrame, approx: bool = False) -> DataFrame:
    count = F.col("cuisine_count")
    return listings.agg(
        distinct_count(F.col("primary_cuisine"), approx).alias("unique_cuisines"),
        round_half_up(exact_mean(count), 2).alias("avg_cuisines"),
        F.max(count).alias("max_cuisines"),
    )


# Ratings and prices


def rating_histogram(listings: DataFrame, bins: int = 25) -> DataFrame:
    return histogram(listings, "rate", bins)


def rating_summary(listings: DataFrame, good_from: float = 3.5) -> DataFrame:
    rate = F.col("rate")
    return listings.agg(
        round_half_up(exact_mean(rate, whole=False), 2).alias("mean_rating"),
        percent(F.count_if(rate >= good_from), F.count(rate)).alias("pct_rated_good"),
        F.count_if(rate.isNull()).alias("unrated_count"),
    )


def price_tier_ratings(listings: DataFrame) -> DataFrame:
    """Count (0 if absent), share and mean rating (null if absent) per tier."""
    tiers = M.with_platform(M.group_sums(listings, ["price_category"]), "_n", few=True).select(
        "price_category",
        M.n_rows().alias("row_count"),
        M.share("_n", "_all_n").alias("pct_of_total"),
        M.avg_rating().alias("avg_rating"),
    )
    return in_label_order(tiers, "price_category", L.PRICE_TIERS, ["row_count", "pct_of_total"])


def cost_summary(listings: DataFrame, approx: bool = False) -> DataFrame:
    return value_range(listings, "approx_cost", approx=approx).select(
        round_half_up(F.col("mean"), 0).alias("avg_cost"),
        round_half_up(F.col("median"), 0).alias("median_cost"),
        F.col("low").alias("min_cost"),
        F.col("high").alias("max_cost"),
    )


# Locations, cuisines, types


def location_ratings(listings: DataFrame, *, top: int = 15, min_rows: int = 100) -> DataFrame:
    """Mean rating of the most frequent locations that are large enough, worst first."""
    largest = (
        M.group_sums(listings, ["location"])
        .filter(F.col("location").isNotNull())
        .orderBy(F.desc("_n"), "location")
        .limit(top)
    )
    return (
        largest.filter(F.col("_n") >= min_rows)
        .select("location", M.n_rows().alias("row_count"), M.avg_rating().alias("avg_rating"))
        .orderBy(F.asc_nulls_last("avg_rating"), "location")
    )


def location_summary(listings: DataFrame, *, top: int = 15, min_rows: int = 100) -> DataFrame:
    """Number of locations, the largest, and the best and worst rated of the top ones."""
    sums = write_stage(
        M.group_sums(listings, ["location"]).select("location", "_n", "_rate", "_rated"), "sums"
    )
    largest = (
        sums.filter(F.col("location").isNotNull())
        .withColumn("_locations", sums.agg(F.count("location")).scalar())
        .orderBy(F.desc("_n"), "location")
        .limit(top)
    )
    rate = M.mean_rate()
    shown = (F.col("_n") >= min_rows) & rate.isNotNull()
    first = F.min(F.struct((-F.col("_n")).alias("n"), "location"))
    high = F.min(F.when(shown, F.struct((-rate).alias("r"), "location")))
    low = F.min(F.when(shown, F.struct(rate.alias("r"), "location")))
    return largest.agg(
        F.max("_locations").alias("total_locations"),
        first["location"].alias("top_location"),
        (-first["n"]).alias("top_location_rows"),
        high["location"].alias("best_location"),
        round_half_up(-high["r"], 2).alias("best_avg_rating"),
        low["location"].alias("worst_location"),
        round_half_up(low["r"], 2).alias("worst_avg_rating"),
    )


def cuisine_ratings(listings: DataFrame, *, top: int = 10) -> DataFrame:
    """Mean rating of the most frequent cuisines, worst first."""
    return (
        M.group_sums(listings, ["primary_cuisine"])
        .filter(F.col("primary_cuisine").isNotNull())
        .orderBy(F.desc("_n"), "primary_cuisine")
        .limit(top)
        .select(
            "primary_cuisine", M.n_rows().alias("row_count"), M.avg_rating().alias("avg_rating")
        )
        .orderBy(F.asc_nulls_last("avg_rating"), "primary_cuisine")
    )


def leader_summary(listings: DataFrame, column: str, *, top: int = 3) -> DataFrame:
    """Distinct values, the most frequent one, and what the top few cover together."""
    counts = listings.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    whole = counts.agg(F.sum("row_count").alias("rows"), F.count(column).alias("distinct"))
    first = F.min(F.struct((-F.col("row_count")).alias("n"), F.col(column).alias("v")))
    total = whole.select("rows").scalar()
    return (
        _first_values(counts, column, top)
        .agg(first.alias("_first"), F.sum("row_count").alias("_covered"))
        .select(
            whole.select("distinct").scalar().alias("unique_values"),
            F.col("_first.v").alias("top_value"),
            (-F.col("_first.n")).alias("top_rows"),
            percent(-F.col("_first.n"), total).alias("top_pct"),
            percent(F.col("_covered"), total).alias("top_coverage_pct"),
        )
    )


# Services


def online_by_tier(listings: DataFrame) -> DataFrame:
    """Online ordering share per tier next to the overall share."""
    tiers = M.with_platform(
        M.group_sums(listings, ["price_category"]), "_online", "_online_n", few=True
    ).select(
        "price_category",
        M.online_pct().alias("online_order_pct"),
        round_half_up(M.online_share("_all") * 100, 1).alias("overall_online_pct"),
    )
    return in_label_order(tiers, "price_category", L.PRICE_TIERS)


def rating_by_service(listings: DataFrame) -> DataFrame:
    """Mean rating with and without online ordering, and the difference, one row."""
    rate, online = F.col("rate"), F.col("online_order")

    def mean_where(flag: int) -> Column:
        chosen = F.when(online == flag, rate)
        return mean_of(F.sum(exact(chosen)), F.count(chosen))

    gap = F.col("_online") - F.col("_dinein")
    return listings.agg(mean_where(1).alias("_online"), mean_where(0).alias("_dinein")).select(
        round_half_up(F.col("_online"), 2).alias("online_avg_rating"),
        round_half_up(F.col("_dinein"), 2).alias("dinein_avg_rating"),
        round_half_up(F.abs(gap), 2).alias("difference"),
        F.when(gap > 0, F.lit("higher")).otherwise(F.lit("lower")).alias("online_is"),
    )


# Correlation


def correlations(
    listings: DataFrame,
    columns: Sequence[str] = NUMERIC_COLUMNS,
    complete: Sequence[str] = COMPLETE_COLUMNS,
) -> DataFrame:
    return correlation_matrix(listings, columns, complete)


def rating_correlations(
    listings: DataFrame,
    target: str = "rate",
    columns: Sequence[str] = NUMERIC_COLUMNS,
    complete: Sequence[str] = COMPLETE_COLUMNS,
) -> DataFrame:
    return target_correlations(correlation_matrix(listings, columns, complete), target)


# Headline insights


def key_insights(listings: DataFrame, *, min_rows: int = 100) -> DataFrame:
    """The closing summary, one wide row from one pass.

    The base rows are aggregated once by (location, cuisine, type). Grouping
    sets over that small frame give each dimension's groups and the totals, and
    a last aggregation picks the leaders.
    """
    rate, online = F.col("rate"), F.col("online_order")
    dimensions = ["location", "primary_cuisine", "rest_type"]
    extra = {
        "_good": F.count_if(rate >= 3.5),
        "_bad": F.count_if(rate < 3.0),
        "_cuisines": F.sum("cuisine_count"),
        "_cuisines_n": F.count("cuisine_count"),
        "_rate_on": F.sum(F.when(online == 1, exact(rate))),
        "_rated_on": F.count(F.when(online == 1, rate)),
        "_rate_off": F.sum(F.when(online == 0, exact(rate))),
        "_rated_off": F.count(F.when(online == 0, rate)),
    }
    cells = M.group_sums(listings, dimensions, *[c.alias(name) for name, c in extra.items()])
    sums = [name for name in cells.columns if name not in dimensions]
    sets = cells.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(
        *[F.sum(name).alias(name) for name in sums], F.grouping_id(*dimensions).alias("_set")
    )
    every = (1 << len(dimensions)) - 1
    set_of = {d: every - (1 << (len(dimensions) - 1 - i)) for i, d in enumerate(dimensions)}

    def groups_of(dimension: str) -> Column:
        return (F.col("_set") == set_of[dimension]) & F.col(dimension).isNotNull()

    def leader(dimension: str) -> Column:
        candidate = F.struct((-F.col("_n")).alias("n"), F.col(dimension).alias("v"))
        return F.min(F.when(groups_of(dimension), candidate)).alias(f"_top_{dimension}")

    rated_enough = (
        groups_of("location") & (F.col("_n") >= min_rows) & M.mean_rate().isNotNull()
    )
    best = F.min(F.when(rated_enough, F.struct((-M.mean_rate()).alias("r"), "location")))
    row = sets.agg(
        *[F.max(F.when(F.col("_set") == every, F.col(name))).alias(name) for name in sums],
        *[F.count_if(groups_of(d)).alias(f"_distinct_{d}") for d in dimensions],
        *[leader(d) for d in dimensions],
        best.alias("_best"),
    )

    def rating_where(suffix: str) -> Column:
        return round_half_up(mean_of(F.col(f"_rate_{suffix}"), F.col(f"_rated_{suffix}")), 2)

    return row.select(
        M.avg_rating().alias("mean_rating"),
        M.share("_good", "_rated").alias("pct_rated_3_5_plus"),
        M.share("_bad", "_rated").alias("pct_rated_poor"),
        M.label_count("Unrated").alias("unrated_count"),
        M.tier_count("Budget").alias("budget_count"),
        M.tier_pct("Budget").alias("budget_pct"),
        M.tier_count("Mid-range").alias("mid_range_count"),
        M.tier_pct("Mid-range").alias("mid_range_pct"),
        M.tier_count("Premium").alias("premium_count"),
        M.tier_pct("Premium").alias("premium_pct"),
        M.avg_cost().alias("avg_cost"),
        F.col("_distinct_location").alias("total_locations"),
        F.col("_top_location.v").alias("top_location"),
        (-F.col("_top_location.n")).alias("top_location_rows"),
        F.col("_best.location").alias("best_rated_location"),
        round_half_up(-F.col("_best.r"), 2).alias("best_location_rating"),
        F.col("_distinct_primary_cuisine").alias("unique_cuisines"),
        F.col("_top_primary_cuisine.v").alias("top_cuisine"),
        (-F.col("_top_primary_cuisine.n")).alias("top_cuisine_rows"),
        F.col("_top_rest_type.v").alias("top_rest_type"),
        (-F.col("_top_rest_type.n")).alias("top_rest_type_rows"),
        round_half_up(ratio(F.col("_cuisines"), F.col("_cuisines_n")), 1).alias("avg_cuisines"),
        M.online_pct().alias("online_order_pct"),
        M.booking_pct().alias("book_table_pct"),
        rating_where("on").alias("online_avg_rating"),
        rating_where("off").alias("dinein_avg_rating"),
    )
