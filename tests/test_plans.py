"""Edge cases of the business questions on hand-made entities."""

from __future__ import annotations

import frames
from pyspark.sql import functions as F

from dirstats.functions import labels as L
from dirstats.plans import cross, cuisine, explore, location, pricing, rating, service, summary
from dirstats.schema import Fields


def rated(rate):
    label = "Unrated" if rate is None else "Excellent" if rate > 4 else "Good"
    return {"rate": rate, "rating_label": label}


def test_tier_without_ratings_has_null_quality(spark):
    df = frames.entities(spark, rated(None), {**rated(4.5), "price_category": "Budget"})
    rows = {r.price_category: r for r in rating.rating_crosstab(df).collect()}
    assert rows["Mid-range"].quality_score_pct is None and rows["Mid-range"].avg_rate is None
    assert rows["Budget"].quality_score_pct == 100.0
    assert [r for r in rows] == ["Budget", "Mid-range"]


def test_one_row_results_of_an_empty_table(spark):
    df = frames.entities(spark, {}).limit(0)
    assert summary.total_rows(df).first()[0] == 0
    assert tuple(summary.unrated(df).first()) == (0, None)
    assert summary.cost_range(df).first().median_cost is None
    assert summary.kpi_snapshot(df).first().unique_locations == 0
    assert pricing.gem_rarity(df).first().proven_gems == 0


def test_null_tier_is_its_own_group(spark):
    df = frames.entities(spark, {"price_category": None}, {"price_category": "Premium"})
    assert frames.column(pricing.tier_performance(df), "price_category") == ["Premium", None]


def test_tier_jumps_use_rounded_averages(spark):
    rows = [
        {"price_category": "Budget", "rate": 3.0, "approx_cost": 100, "votes": 1},
        {"price_category": "Mid-range", "rate": 3.2, "approx_cost": 500, "votes": 5},
        {"price_category": "Premium", "rate": 3.6, "approx_cost": 900, "votes": 5},
    ]
    found = pricing.tier_performance(frames.entities(spark, *rows)).collect()
    assert [r.rating_jump_vs_prev for r in found] == [None, 0.2, 0.4]
    assert [r.cost_jump_vs_prev for r in found] == [None, 400.0, 400.0]
    verdicts = [r.price_jump_verdict.split()[0] for r in found]
    assert verdicts == ["Baseline", "Marginal", "Justified"]


def test_rank_ties_share_a_rank(spark):
    rows = [{"location": k, "approx_cost": c} for k, c in (("a", 500), ("b", 500), ("c", 600))]
    df = frames.entities(spark, *rows)
    found = location.best_value(df, min_rows=1, min_rated=1, min_rate=3.0).collect()
    assert [(r.location, r.value_rank) for r in found] == [("a", 1), ("b", 1), ("c", 3)]


def test_value_floor_uses_the_unrounded_mean(spark):
    rows = [{"rate": 3.5}] * 199 + [{"rate": 3.4}]
    df = frames.entities(spark, *rows)
    assert location.best_value(df).isEmpty()
    assert location.leaderboard(df).first().avg_rating == 3.5


def test_market_type_uses_the_rounded_percent(spark):
    rows = [{"online_order": 1}] * 1399 + [{"online_order": 0}] * 600
    found = location.digital_adoption(frames.entities(spark, *rows)).first()
    assert found.online_order_pct == 70.0 and found.market_type == "Heavy Delivery"


def test_dominant_cuisine_tie_goes_to_the_first_name(spark):
    rows = [{"primary_cuisine": c} for c in ("Thai", "Indian", "Thai", "Indian", "Cafe")]
    found = cuisine.dominant_per_location(frames.entities(spark, *rows)).first()
    assert (found.dominant_cuisine, found.dominant_cuisine_count) == ("Indian", 2)
    assert (found.total_restaurants, found.cuisine_share_pct) == (5, 40.0)


def test_rank_gap_sign(spark):
    rows = [{"primary_cuisine": "big", "rate": 3.0}] * 3 + [{"primary_cuisine": "good"}] * 2
    gaps = {
        r.primary_cuisine: r.rank_gap
        for r in cuisine.rank_gap(frames.entities(spark, *rows), min_rows=1).collect()
    }
    assert gaps == {"big": -1, "good": 1}


def test_unrated_cuisine_ranks_last(spark):
    rows = [{"primary_cuisine": "none", **rated(None)}, {"primary_cuisine": "some", "rate": 2.0}]
    found = cuisine.quality(frames.entities(spark, *rows), min_rows=1).collect()
    assert [(r.primary_cuisine, r.quality_rank) for r in found] == [("some", 1), ("none", 2)]


def test_hidden_gems_bucket_over_all_gems(spark):
    gems = [
        {"name": f"g{v}", "votes": v, "price_category": "Budget", **rated(4.2)}
        for v in range(100, 109)
    ]
    df = frames.entities(spark, *gems, {"name": "low", "votes": 99}, rated(3.6))
    top = pricing.hidden_gems(df, top=4).collect()
    assert [r.proof_bucket for r in top] == [1, 1, 1, 2]
    assert [r.gem_rank for r in top] == [1, 2, 3, 4]
    assert {r.beats_pct_of_platform for r in top} == {18.2}
    buckets = {r.name: r.proof_bucket for r in pricing.gem_proof_buckets(df).collect()}
    assert sorted(buckets.values()) == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_benchmark_row_differs_from_null_flags(spark):
    df = frames.entities(spark, {"online_order": None}, {"online_order": 1, "book_table": 1})
    rows = service.service_segments(df).collect()
    assert [r.service_segment for r in rows] == [
        "1. Both Services",
        "4. Neither",
        L.BENCHMARK_SEGMENT,
    ]
    assert (rows[-1].total_restaurants, rows[-1].pct_of_platform) == (2, 100.0)
    assert (rows[-1].vs_platform_avg, rows[-1].digital_verdict) == (0.0, "Benchmark")


def test_even_sized_median(spark):
    rows = [{"rate": r, "approx_cost": c} for r, c in ((3.0, 100), (3.0, 100), (4.0, 300))]
    df = frames.entities(spark, *rows, {"rate": 4.0, "approx_cost": 300})
    found = service.online_vs_dinein(df).first()
    assert (found.median_rating, found.median_cost) == (3.5, 200.0)


def test_coordinates(spark):
    dim = spark.createDataFrame(
        [("in", 13.0, 77.5), ("out", 14.0, 77.5), ("fixed", 13.0, 77.4)],
        "location string, latitude double, longitude double",
    )
    overrides = spark.createDataFrame(
        [("fixed", 10.0, 70.0)], "location string, latitude double, longitude double"
    )
    resolved = cross.resolve_coordinates(dim, overrides)
    assert {r.location: r.latitude for r in resolved.collect()} == {"in": 13.0, "fixed": 10.0}
    df = frames.entities(spark, *[{"location": k} for k in ("in", "out", "fixed", "new")])
    assert frames.column(cross.unresolved_locations(df, resolved), "location") == ["new", "out"]
    mapped = {r.location: r.latitude for r in cross.location_map(df, resolved).collect()}
    assert mapped == {"in": 13.0, "out": None, "fixed": 10.0, "new": None}


def test_pivot_has_every_tier(spark):
    row = cross.tier_by_location(frames.entities(spark, {})).first()
    assert (row.budget_count, row.mid_range_count, row.premium_count) == (0, 1, 0)
    assert row.budget_avg_rating is None and row.mid_range_avg_rating == 3.9


def test_location_ratings_need_enough_rows(spark):
    rows = [{"location": "a"}] * 3 + [{"location": "b", "rate": 2.0}] * 2 + [{"location": "c"}]
    df = frames.listings(spark, *rows)
    found = explore.location_ratings(df, top=3, min_rows=2)
    assert frames.column(found, "location") == ["b", "a"]
    summary_row = explore.location_summary(df, top=3, min_rows=2).first()
    assert (summary_row.best_location, summary_row.worst_location) == ("a", "b")
    assert summary_row.total_locations == 3


def test_leaders_cover_a_share_of_all_rows(spark):
    df = spark.createDataFrame([(k,) for k in [*"aaabbc", None, None]], "k string")
    found = explore.leader_summary(df, "k", top=2).first()
    assert tuple(found) == (3, "a", 3, 37.5, 62.5)


def test_service_difference(spark):
    rows = [{"online_order": 1, "rate": 4.0}, {"online_order": 0, "rate": 3.5}]
    found = explore.rating_by_service(frames.listings(spark, *rows)).first()
    assert tuple(found) == (4.0, 3.5, 0.5, "higher")


def test_other_tables_and_thresholds(spark):
    """The same question over another dimension of another table."""
    df = frames.entities(spark, {"listed_city": "x"}, {"listed_city": "y"}, {"listed_city": "y"})
    found = location.leaderboard(df, by="listed_city", min_rows=2).collect()
    assert [(r.listed_city, r.total_restaurants) for r in found] == [("y", 2)]
    assert found[0].market_share_pct == 66.7


def test_other_column_names(spark):
    df = frames.entities(spark, {"rate": 2.0}, {"rate": 3.0}).withColumnsRenamed(
        {"rate": "stars", "approx_cost": "price", "location": "area"}
    )
    fields = Fields(rate="stars", cost="price")
    found = location.best_value(
        df, by="area", min_rows=1, min_rated=1, min_rate=1.0, fields=fields
    ).first()
    assert (found.area, found.avg_rating, found.avg_cost, found.value_score) == (
        "North",
        2.5,
        500.0,
        0.5,
    )


def test_most_credible_breaks_ties(spark):
    rows = [{"name": n, "votes": 600, "rate": 4.5} for n in "cab"]
    found = rating.most_credible(frames.entities(spark, *rows), top=2)
    assert frames.column(found, "name") == ["a", "b"]
    assert found.select(F.max("credibility_score")).first()[0] == 12.5
