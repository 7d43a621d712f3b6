"""Questions about locations: size, value for money, digital adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numeric import round_half_up
from ..operators import sums as M
from ..operators.cumulative import with_ranks
from ..operators.ranking import top_ranked
from ..schema import FIELDS, Fields


def _value_floor(min_rows: int, min_rated: int, min_rate: float) -> Column:
    """The floors compare the unrounded mean."""
    return (
        (F.col("_n") >= min_rows) & (F.col("_rated") >= min_rated) & (M.mean_rate() >= min_rate)
    )


def _vs_platform_online() -> Column:
    return round_half_up(M.online_pct() - M.online_share("_all") * 100, 1)


def _market_type() -> Column:
    """Decided on the rounded percentage."""
    return L.at_least(M.online_pct(), L.MARKET_TYPES, L.MARKET_ELSE)


def leaderboard(
    entities: DataFrame,
    *,
    by: str = "location",
    min_rows: int = 100,
    top: int = 15,
    fields: Fields = FIELDS,
) -> DataFrame:
    """Largest locations with share of the whole table and averages."""
    return (
        M.with_platform(M.group_sums(entities, [by], fields=fields), "_n")
        .filter(F.col("_n") >= min_rows)
        .select(
            by,
            M.n_rows().alias("total_restaurants"),
            M.share("_n", "_all_n").alias("market_share_pct"),
            M.avg_rating().alias("avg_rating"),
            M.avg_cost().alias("avg_cost"),
            M.quality_score().alias("quality_score_pct"),
            M.online_pct().alias("online_order_pct"),
            M.unrated_pct().alias("unrated_pct"),
        )
        .orderBy(F.desc("total_restaurants"), by)
        .limit(top)
    )


def best_value(
    entities: DataFrame,
    *,
    by: str = "location",
    min_rows: int = 100,
    min_rated: int = 50,
    min_rate: float = 3.5,
    top: int = 15,
    fields: Fields = FIELDS,
) -> DataFrame:
    """Rating per unit of cost among locations that pass three floors."""
    scored = (
        M.group_sums(entities, [by], fields=fields)
        .filter(_value_floor(min_rows, min_rated, min_rate))
        .select(
            by,
            M.n_rows().alias("total_restaurants"),
            M.avg_rating().alias("avg_rating"),
            M.avg_cost().alias("avg_cost"),
            M.quality_score().alias("quality_score_pct"),
            M.online_pct().alias("online_order_pct"),
            M.unrated_pct().alias("unrated_pct"),
            M.value_score().alias("value_score"),
        )
    )
    ranked = top_ranked(scored, F.desc("value_score"), [F.col(by)], top, "value_rank")
    return ranked.select("value_rank", *scored.columns)


def digital_adoption(
    entities: DataFrame,
    *,
    by: str = "location",
    min_rows: int = 100,
    top: int = 15,
    fields: Fields = FIELDS,
) -> DataFrame:
    """Online ordering and booking per location against the platform."""
    scored = (
        M.with_platform(M.group_sums(entities, [by], fields=fields), "_online", "_online_n")
        .filter(F.col("_n") >= min_rows)
        .select(
            by,
            M.n_rows().alias("total_restaurants"),
            M.online_pct().alias("online_order_pct"),
            M.booking_pct().alias("book_table_pct"),
            _vs_platform_online().alias("vs_platform_avg"),
            M.digital_score().alias("digital_score"),
            M.avg_rating().alias("avg_rating"),
            M.avg_cost().alias("avg_cost"),
            _market_type().alias("market_type"),
        )
    )
    ranked = top_ranked(scored, F.desc("online_order_pct"), [F.col(by)], top, "digital_rank")
    return ranked.select("digital_rank", *scored.columns)


def scorecard(
    entities: DataFrame,
    *,
    by: str = "location",
    min_rows: int = 100,
    min_rated: int = 50,
    min_rate: float = 3.5,
    fields: Fields = FIELDS,
) -> DataFrame:
    """Size, value and digital ranking side by side for every large location.

    The rankings are taken over ranges of the same staged sums; a location below
    the value floors has a null value rank and score.
    """
    qualifies = _value_floor(min_rows, min_rated, min_rate)
    value = F.when(qualifies, M.value_score())
    scored = (
        M.with_platform(M.group_sums(entities, [by], fields=fields), "_n", "_online", "_online_n")
        .filter(F.col("_n") >= min_rows)
        .select(
            by,
            M.n_rows().alias("total_restaurants"),
            M.share("_n", "_all_n").alias("market_share_pct"),
            M.avg_rating().alias("avg_rating"),
            M.avg_cost().alias("avg_cost"),
            M.quality_score().alias("quality_score_pct"),
            value.alias("value_score"),
            M.online_pct().alias("online_order_pct"),
            _vs_platform_online().alias("vs_platform_avg"),
            M.digital_score().alias("digital_score"),
            _market_type().alias("market_type"),
        )
    )
    ranks = {"value_rank": ("value_score", True), "digital_rank": ("online_order_pct", True)}
    ranked = with_ranks(scored, ranks)
    shown = F.when(F.col("value_score").isNotNull(), F.col("value_rank"))
    return ranked.select(
        *scored.columns[:6],
        shown.alias("value_rank"),
        "value_score",
        "digital_rank",
        *scored.columns[7:],
    ).orderBy(F.desc("total_restaurants"), by)
