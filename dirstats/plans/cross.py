"""Results that join or pivot across dimensions: maps, heatmaps, coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import PRICE_TIERS
from ..operators import sums as M
from ..operators.joins import missing_keys

# Bounding box that valid coordinates fall into.
LATITUDE_RANGE = (12.7, 13.3)
LONGITUDE_RANGE = (77.3, 77.9)


def distinct_locations(df: DataFrame, column: str = "location") -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def resolve_coordinates(
    coordinates: DataFrame,
    overrides: DataFrame,
    *,
    latitude: tuple[float, float] = LATITUDE_RANGE,
    longitude: tuple[float, float] = LONGITUDE_RANGE,
) -> DataFrame:
    """Usable coordinates: overrides as given, the rest only inside the box."""
    inside = F.col("latitude").between(*latitude) & F.col("longitude").between(*longitude)
    resolved = coordinates.filter(inside).join(overrides, "location", "left_anti")
    return overrides.unionByName(resolved.select(*overrides.columns))


def attach_coordinates(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every row with its location's coordinates, null where there are none.

    No broadcast hint: the planner broadcasts the dimension when its measured
    size allows, and otherwise splits a hot location's partition.
    """
    return df.join(resolved, "location", "left")


def location_map(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per location: entities, mean rating and cost, coordinates."""
    per_location = (
        M.group_sums(entities, ["location"])
        .filter(F.col("location").isNotNull())
        .select(
            "location",
            M.n_rows().alias("total_restaurants"),
            M.avg_rating().alias("avg_rating"),
            M.avg_cost().alias("avg_cost"),
        )
    )
    return attach_coordinates(per_location, resolved).orderBy("location")


def unresolved_locations(df: DataFrame, resolved: DataFrame) -> DataFrame:
    return missing_keys(df, resolved, "location").orderBy("location")


def tier_by_location(entities: DataFrame, tiers: Sequence[str] = PRICE_TIERS) -> DataFrame:
    """Entities and mean rating per location and price tier, one column pair per tier.

    Aggregated to one row per (location, tier) first, then pivoted with the tier
    names given, so there is no extra pass to find them.
    """
    cells = M.group_sums(entities, ["location", "price_category"]).select(
        "location",
        "price_category",
        M.n_rows().alias("_count"),
        M.avg_rating().alias("_rating"),
    )

    def slug(tier: str) -> str:
        return tier.lower().replace("-", "_")

    pivoted = (
        cells.groupBy("location")
        .pivot("price_category", list(tiers))
        .agg(F.first("_count").alias("count"), F.first("_rating").alias("avg_rating"))
    )
    return pivoted.select(
        "location",
        *[
            F.coalesce(F.col(f"`{t}_count`"), F.lit(0)).alias(f"{slug(t)}_count") for t in tiers
        ],
        *[F.col(f"`{t}_avg_rating`").alias(f"{slug(t)}_avg_rating") for t in tiers],
    ).orderBy("location")


def cuisine_by_location(entities: DataFrame, *, min_rows: int = 1) -> DataFrame:
    """Quality of each cuisine in each location, one row per pair."""
    return (
        M.group_sums(entities, ["primary_cuisine", "location"])
        .filter(F.col("_n") >= min_rows)
        .select(
            "primary_cuisine",
            "location",
            M.n_rows().alias("total_restaurants"),
            M.avg_rating().alias("avg_rating"),
            M.quality_score().alias("quality_score_pct"),
        )
        .orderBy("primary_cuisine", "location")
    )
