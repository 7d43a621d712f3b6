"""Questions about services: online ordering, table booking, and both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numeric import percent, round_half_up
from ..operators import sums as M
from ..operators.cumulative import exact_medians, value_counts_of
from ..operators.joins import null_safe_join
from ..schema import FIELDS, Fields


def online_vs_dinein(entities: DataFrame) -> DataFrame:
    """Online ordering against dine-in only.

    Each exact median is found by position in staged counts of (flag, value), which are as
    narrow as they can be: a continuous rating or cost has about as many of them as rows.
    """
    flags = M.group_sums(entities, ["online_order"])
    for value, out in (("rate", "_median_rate"), ("approx_cost", "_median_cost")):
        counts = value_counts_of(entities, value, ["online_order"])
        medians = exact_medians(counts, value, by=["online_order"], out=out)
        flags = null_safe_join(flags, medians, ["online_order"], "left")
    return (
        M.with_platform(flags, "_n", "_rate", "_rated", few=True)
        .orderBy(F.desc("online_order"))
        .select(
            L.service_type(F.col("online_order")).alias("service_type"),
            M.n_rows().alias("total_restaurants"),
            M.share("_n", "_all_n").alias("pct_of_platform"),
            M.avg_rating().alias("avg_rating"),
            round_half_up(F.col("_median_rate"), 2).alias("median_rating"),
            round_half_up(M.mean_rate() - M.mean_rate("_all"), 2).alias("vs_platform_avg"),
            M.avg_cost().alias("avg_cost"),
            round_half_up(F.col("_median_cost"), 0).alias("median_cost"),
            M.avg_votes().alias("avg_votes"),
            M.booking_pct().alias("also_book_table_pct"),
            M.quality_score().alias("quality_score_pct"),
            M.label_pct("Excellent").alias("excellent_pct"),
            M.label_pct("Poor").alias("poor_pct"),
            M.unrated_pct().alias("unrated_pct"),
            M.value_score().alias("value_score"),
        )
    )


def tier_composition(entities: DataFrame) -> DataFrame:
    """Price tiers within each service type."""
    in_service = F.sum("_n").over(W.partitionBy("online_order"))
    return (
        M.group_sums(entities, ["online_order", "price_category"])
        .withColumn("_service_n", in_service)
        .orderBy(
            F.desc("online_order"),
            L.ordinal(F.col("price_category"), L.PRICE_TIERS).asc_nulls_last(),
        )
        .select(
            L.service_type(F.col("online_order")).alias("service_type"),
            "price_category",
            M.n_rows().alias("restaurant_count"),
            percent(F.col("_n"), F.col("_service_n")).alias("pct_within_service"),
            M.avg_rating().alias("avg_rating"),
            M.avg_cost().alias("avg_cost"),
            M.avg_votes().alias("avg_votes"),
        )
    )


def service_segments(entities: DataFrame) -> DataFrame:
    """Four service segments and the platform as a benchmark row.

    The rollup that adds the benchmark row expands one row of sums per segment; the exact
    medians are found by position in staged counts of (segment, rating).
    """
    segment = L.service_segment(F.col("online_order"), F.col("book_table"))
    named = entities.withColumn("service_segment", segment)
    sums = M.group_sums(named, ["service_segment"]).rollup("service_segment").agg(
        *M.merged_columns(), F.grouping("service_segment").cast("int").alias("_is_total")
    )
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    counts = (
        value_counts_of(named, "rate", ["service_segment"])
        .select("service_segment", "rate", "_n", both.alias("_is_total"))
        .withColumn("service_segment", F.when(F.col("_is_total") == 0, F.col("service_segment")))
        .groupBy("_is_total", "service_segment", "rate")
        .agg(F.sum("_n").alias("_n"))
    )
    group = ["_is_total", "service_segment"]
    medians = exact_medians(counts, "rate", by=group, out="_median_rate")
    rolled = null_safe_join(sums, medians, group, "left")
    is_total = F.col("_is_total") == 1
    total = W.partitionBy()

    def of_platform(name: str) -> Column:
        return F.max(F.when(is_total, F.col(name))).over(total).alias(f"_all{name}")

    known = rolled.select("*", *[of_platform(c) for c in ("_n", "_rate", "_rated")])
    vs_platform = round_half_up(M.avg_rating() - M.mean_rate("_all"), 2)
    verdict = L.at_least(M.avg_rating(), L.DIGITAL_VERDICTS, L.DIGITAL_ELSE)
    return known.select(
        F.when(is_total, F.lit(L.BENCHMARK_SEGMENT))
        .otherwise(F.col("service_segment"))
        .alias("service_segment"),
        M.n_rows().alias("total_restaurants"),
        F.when(is_total, F.lit(100.0)).otherwise(M.share("_n", "_all_n")).alias("pct_of_platform"),
        M.avg_rating().alias("avg_rating"),
        round_half_up(F.col("_median_rate"), 2).alias("median_rating"),
        F.when(is_total, F.lit(0.0)).otherwise(vs_platform).alias("vs_platform_avg"),
        M.avg_cost().alias("avg_cost"),
        M.avg_votes().alias("avg_votes"),
        M.quality_score().alias("quality_score_pct"),
        M.label_pct("Excellent").alias("excellent_pct"),
        M.label_pct("Poor").alias("poor_pct"),
        M.unrated_pct().alias("unrated_pct"),
        M.tier_pct("Premium").alias("premium_pct"),
        M.value_score().alias("value_score"),
        F.when(is_total, F.lit(L.BENCHMARK_VERDICT)).otherwise(verdict).alias("digital_verdict"),
    ).orderBy("service_segment")


def service_by_tier(
    entities: DataFrame, by: str = "price_category", *, fields: Fields = FIELDS
) -> DataFrame:
    """Share of each service segment within a price tier."""
    return (
        M.group_sums(entities, [by], fields=fields)
        .select(
            by,
            M.n_rows().alias("total_in_tier"),
            M.share("_both").alias("both_services_pct"),
            M.share("_online_only").alias("online_only_pct"),
            M.share("_table_only").alias("table_only_pct"),
            M.share("_neither").alias("neither_pct"),
            M.avg_rating().alias("tier_avg_rating"),
        )
        .orderBy(L.ordinal(F.col(by), L.PRICE_TIERS).asc_nulls_last())
    )
