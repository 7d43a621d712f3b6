"""Questions about ratings: credibility, labels by tier, votes against rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores
from ..operators import sums as M
from ..schema import FIELDS, Fields


def most_credible(
    entities: DataFrame, *, min_rate: float = 4.0, min_votes: int = 500, top: int = 10
) -> DataFrame:
    """Well rated entities with enough votes, by rating times log of votes."""
    return (
        entities.filter((F.col("rate") >= min_rate) & (F.col("votes") >= min_votes))
        .select(
            "name",
            "location",
            "primary_cuisine",
            "rest_type",
            "rate",
            "votes",
            F.col("approx_cost").alias("cost_for_two"),
            "price_category",
            "online_order",
            "book_table",
            scores.credibility(F.col("rate"), F.col("votes")).alias("credibility_score"),
        )
        .orderBy(F.desc("credibility_score"), F.desc("votes"), "name", "location")
        .limit(top)
    )


def rating_crosstab(
    entities: DataFrame, by: str = "price_category", *, fields: Fields = FIELDS
) -> DataFrame:
    """Count and share of every rating label per price tier."""
    cells = []
    for label in L.RATING_LABELS:
        cells += [
            M.label_count(label).alias(f"{label.lower()}_count"),
            M.label_pct(label).alias(f"{label.lower()}_pct"),
        ]
    return (
        M.group_sums(entities, [by], fields=fields)
        .select(
            by,
            M.n_rows().alias("total_restaurants"),
            M.avg_rating().alias("avg_rate"),
            *cells,
            M.quality_score().alias("quality_score_pct"),
        )
        .orderBy(L.ordinal(F.col(by), L.PRICE_TIERS).asc_nulls_last())
    )


def vote_buckets(entities: DataFrame) -> DataFrame:
    """Does vote volume predict the rating? Metrics per vote range."""
    bucketed = entities.withColumn("vote_bucket", L.vote_bucket(F.col("votes")))
    extremes = F.min("rate").alias("min_rating"), F.max("rate").alias("max_rating")
    return (
        M.group_sums(bucketed, ["vote_bucket"], *extremes)
        .select(
            "vote_bucket",
            M.n_rows().alias("total_restaurants"),
            M.avg_votes().alias("avg_votes"),
            M.avg_rating().alias("avg_rating"),
            M.unrated().alias("unrated_count"),
            M.unrated_pct().alias("unrated_pct"),
            M.quality_score().alias("quality_score_pct"),
            "min_rating",
            "max_rating",
        )
        .orderBy("vote_bucket")
    )
