"""Every named query bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import cleaning, entities, joins, profile
from ..plans import cross, cuisine, explore, location, pricing, rating, service, summary
from ..sources import readers, staging, writers
from . import binding

Query = Callable[[SparkSession, str], DataFrame]


def _entities(plan: Callable[..., DataFrame], *args: object) -> Query:
    return lambda spark, sf_dir: plan(binding.entities(spark, sf_dir), *args)


def _listings(plan: Callable[..., DataFrame], *args: object) -> Query:
    return lambda spark, sf_dir: plan(binding.listings(spark, sf_dir), *args)


def _raw(plan: Callable[..., DataFrame], *args: object) -> Query:
    return lambda spark, sf_dir: plan(
        binding.raw_listings(spark, sf_dir).select(*[f"`{c}`" for c in S.RAW.fieldNames()]), *args
    )


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_parsed(binding.parsed(spark, sf_dir), binding.INGEST_ORDER)


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.raw_listings(spark, sf_dir)
    return cleaning.parse_listings(raw).select(*S.CLEAN.fieldNames())


def _row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.drop_incomplete(binding.parsed(spark, sf_dir))
    return cleaning.duplicate_report(rows.select(*S.CLEAN.fieldNames()))


def _null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.null_drop_report(binding.parsed(spark, sf_dir))


def _raw_duplicates(raw: DataFrame) -> DataFrame:
    return cleaning.duplicate_report(raw, by_digest=True)


def _clean_profile(listings: DataFrame) -> DataFrame:
    return profile.cleaned_profile(listings.select(*S.CLEAN.fieldNames()))


def _mean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.clean_parsed(
        binding.parsed(spark, sf_dir), binding.INGEST_ORDER, keep_order=True
    )
    return entities.dedup_entities(
        cleaning.with_features(rows), strategy="mean", order="_order"
    )


def _write_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = binding.listings(spark, sf_dir)
    path = staging.new_path(spark, "verify")
    writers.write_parquet(listings, path)
    return writers.verify_written(listings, readers.read_table(spark, path))


def _by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.sql_over(
        spark,
        "SELECT listed_type, count(*) AS row_count, sum(votes) AS total_votes "
        "FROM {listings} WHERE approx_cost > 400 GROUP BY listed_type",
        {"listings": binding.listings(spark, sf_dir)},
    )


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.reconcile(
        binding.listings(spark, sf_dir),
        binding.entities(spark, sf_dir),
        S.ENTITY_KEYS,
        ["votes"],
        names=("listing", "entity"),
    )


def _named_rows(table: DataFrame) -> DataFrame:
    most_voted = (
        table.groupBy("name")
        .agg(F.sum("votes").alias("_votes"))
        .orderBy(F.desc("_votes"), "name")
        .limit(3)
        .select("name")
    )
    return joins.keep_keys(table, most_voted).select("name", "location", "votes", "rate")


def _spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table against the survivors that the listings themselves give."""
    survivors = entities.dedup_entities(binding.listings(spark, sf_dir))
    expected = rating.most_credible(survivors).select("name", "location", "votes", "rate")
    return entities.spot_check(binding.entities(spark, sf_dir), expected)


def _through_csv(df: DataFrame, label: str, **options: object) -> str:
    path = staging.new_path(df.sparkSession, label)
    writers.write_csv(df, path, **options)
    return path


def _csv_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _through_csv(binding.listings(spark, sf_dir), "listings-csv", compression="gzip")
    return readers.read_listings(spark, path)


def _csv_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning from a quoted export of several files whose rows bring no order of their own."""
    raw = binding.raw_listings(spark, sf_dir, in_order=True)
    review = F.concat(F.lit('said "good",\n"'), F.col("name"), F.lit('"\n'))
    fields = [F.col(f"`{c}`") for c in S.RAW.fieldNames()]
    ordered = raw.withColumn("reviews_list", review).select(*fields)
    path = _through_csv(ordered, "raw-csv", compression="gzip")
    exported = readers.read_raw(spark, path, ordinal="place")
    parsed = staging.write_stage(cleaning.parse_listings(exported), "parsed-csv")
    return cleaning.clean_parsed(parsed, ["place"])


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate file in which some records lack a field and some a number."""
    key = F.col("c_custkey")
    latitude = F.when(key % 11 == 0, F.lit("north")).otherwise((key % 90).cast("string"))
    fields = [F.concat(F.lit('"'), "c_name", F.lit('"')), latitude]
    longitude = F.when(key % 7 != 0, (key % 180).cast("string"))
    lines = readers.read_table(spark, f"{sf_dir}/customer.parquet").select(
        F.concat_ws(",", *fields, longitude).alias("line"), F.spark_partition_id().alias("part")
    )
    path = staging.new_path(spark, "bad-csv")
    header = F.lit(",".join(S.COORD.fieldNames()))
    headed = lines.withColumn("line", F.explode(F.array("line")))
    titles = lines.limit(1).select(header.alias("line"), F.lit(-1).alias("part"))
    one_file = headed.unionByName(titles).coalesce(1).sortWithinPartitions("part")
    one_file.select("line").write.text(path)
    rows = readers.read_csv(spark, path, S.COORD, malformed="problem")
    return readers.malformed_report(rows, "problem")


def _csv_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _through_csv(_coordinates(spark, sf_dir), "coordinates-csv", sort_by=["location"])
    rows = binding.entities(spark, sf_dir).select("name", "location", "rate", "approx_cost")
    return cross.attach_coordinates(rows, readers.read_coordinates(spark, path))


def _csv_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = pricing.tier_performance(binding.entities(spark, sf_dir))
    folder = staging.new_path(spark, "results-csv")
    writers.write_results({"tiers": result}, folder)
    return readers.read_result(spark, f"{folder}/tiers", result.schema)


def _first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binding.parsed(spark, sf_dir).orderBy(*binding.INGEST_ORDER)
    return profile.preview(rows).select(*S.CLEAN.fieldNames())


def _active_rows(listings: DataFrame) -> DataFrame:
    active = joins.keys_with_at_least(listings, "location", 100)
    kept = joins.keep_keys(listings, active, stage=True)
    return kept.select("name", "location", "listed_type", "votes", "rate")


def _top_cuisine_rows(listings: DataFrame) -> DataFrame:
    kept = joins.keep_keys(listings, joins.most_frequent_keys(listings, "primary_cuisine", 10))
    return kept.select("name", "location", "primary_cuisine", "rate")


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.resolve_coordinates(
        binding.coordinates(spark, sf_dir), binding.overrides(spark)
    )


def _attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binding.entities(spark, sf_dir).select("name", "location", "rate", "approx_cost")
    return cross.attach_coordinates(rows, _coordinates(spark, sf_dir))


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.location_map(binding.entities(spark, sf_dir), _coordinates(spark, sf_dir))


def _unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.unresolved_locations(
        binding.listings(spark, sf_dir), _coordinates(spark, sf_dir)
    )


SUMMARIES: dict[str, Query] = {
    "sum_01_total": _entities(summary.total_rows),
    "sum_02_locations": _entities(summary.distinct_values, "location", "total_locations"),
    "sum_03_cuisines": _entities(summary.distinct_values, "primary_cuisine", "total_cuisines"),
    "sum_04_rest_types": _entities(summary.distinct_values, "rest_type", "total_rest_types"),
    "sum_05_rating_range": _entities(summary.rating_range),
    "sum_06_unrated": _entities(summary.unrated),
    "sum_07_cost_range": _entities(summary.cost_range),
    "sum_08_votes_range": _entities(summary.votes_range),
    "sum_09_online": _entities(summary.adoption, "online_order", "online_order"),
    "sum_10_booking": _entities(summary.adoption, "book_table", "table_booking"),
    "sum_11_price_dist": _entities(summary.distribution, "price_category"),
    "sum_12_label_dist": _entities(summary.distribution, "rating_label"),
    "kpi_snapshot": _entities(summary.kpi_snapshot),
    "table_check": _listings(writers.table_check),
}

QUESTIONS: dict[str, Query] = {
    "q1_credible": _entities(rating.most_credible),
    "q2_rating_crosstab": _entities(rating.rating_crosstab),
    "q3_vote_buckets": _entities(rating.vote_buckets),
    "q4_location_leaderboard": _entities(location.leaderboard),
    "q5_value_locations": _entities(location.best_value),
    "q6_digital_adoption": _entities(location.digital_adoption),
    "q7a_dominant_cuisine": _entities(cuisine.dominant_per_location),
    "q7b_dominance_summary": _entities(cuisine.dominance_summary),
    "q8a_cuisine_popularity": _entities(cuisine.popularity),
    "q8b_cuisine_quality": _entities(cuisine.quality),
    "q9_price_tier": _entities(pricing.tier_performance),
    "q10a_hidden_gems": _entities(pricing.hidden_gems),
    "q10b_gem_rarity": _entities(pricing.gem_rarity),
    "q11a_online_vs_dinein": _entities(service.online_vs_dinein),
    "q11b_tier_composition": _entities(service.tier_composition),
    "q12a_service_segments": _entities(service.service_segments),
    "q12b_service_by_tier": _entities(service.service_by_tier),
    "gem_proof_buckets": _entities(pricing.gem_proof_buckets),
    "rating_percentiles": _entities(pricing.rating_percentiles),
    "cuisine_rank_gap": _entities(cuisine.rank_gap),
    "location_scorecard": _entities(location.scorecard),
}

CLEANING: dict[str, Query] = {
    "parse_listings": _parse,
    "clean_listings": _clean,
    "engineer_features": lambda spark, sf_dir: cleaning.with_features(_clean(spark, sf_dir)),
    "profile_missing": _raw(profile.missing_profile),
    "profile_frequencies": _raw(explore.raw_frequencies),
    "duplicate_rows": _raw(_raw_duplicates),
    "null_drop_report": _null_drop,
    "row_dedup_report": _row_dedup,
    "reject_report": _raw(cleaning.reject_report),
    "cleaned_profile": _listings(_clean_profile),
    "write_verify": _write_verify,
    "column_profile": lambda spark, sf_dir: profile.column_profile(_clean(spark, sf_dir)),
    "first_rows": _first_rows,
    "csv_listings": _csv_listings,
    "csv_clean_listings": _csv_clean,
    "csv_malformed_report": _csv_rejects,
    "csv_attach_coordinates": _csv_attach,
    "csv_result": _csv_result,
    "listings_by_sql": _by_sql,
    "distinct_locations": _listings(cross.distinct_locations),
}

ENTITIES: dict[str, Query] = {
    "entity_dedup_max_votes": _listings(entities.dedup_entities),
    "entity_dedup_mean": _mean_entities,
    "entity_dup_report": _listings(entities.duplication_report),
    "entity_listing_distribution": _listings(entities.size_distribution),
    "entity_most_duplicated": _listings(entities.most_duplicated),
    "entity_consistency": _listings(entities.consistency_report),
    "entity_named_rows": _entities(_named_rows),
    "entity_spot_check": _spot_check,
    "reconcile_totals": _reconcile,
}

EXPLORATION: dict[str, Query] = {
    "feature_price_tiers": _listings(explore.price_tier_stats),
    "feature_rating_labels": _listings(explore.rating_label_shares),
    "feature_top_cuisines": _listings(explore.top_shares, "primary_cuisine", 20),
    "feature_cuisine_counts": _listings(explore.cuisine_count_distribution),
    "feature_cuisine_summary": _listings(explore.cuisine_feature_summary),
    "eda_rating_histogram": _listings(explore.rating_histogram),
    "eda_rating_summary": _listings(explore.rating_summary),
    "eda_price_tiers": _listings(explore.price_tier_ratings),
    "eda_cost_summary": _listings(explore.cost_summary),
    "eda_location_top": _listings(explore.top_shares, "location", 15),
    "eda_location_ratings": _listings(explore.location_ratings),
    "eda_location_summary": _listings(explore.location_summary),
    "eda_cuisine_top": _listings(explore.top_shares, "primary_cuisine", 15),
    "eda_cuisine_ratings": _listings(explore.cuisine_ratings),
    "eda_cuisine_summary": _listings(explore.leader_summary, "primary_cuisine"),
    "eda_online_by_tier": _listings(explore.online_by_tier),
    "eda_rating_by_service": _listings(explore.rating_by_service),
    "eda_rest_types": _listings(explore.top_shares, "rest_type", 10),
    "eda_rest_type_summary": _listings(explore.leader_summary, "rest_type"),
    "eda_correlation": _listings(explore.correlations),
    "eda_rate_correlation": _listings(explore.rating_correlations),
    "eda_key_insights": _listings(explore.key_insights),
    "rows_in_active_locations": _listings(_active_rows),
    "rows_of_top_cuisines": _listings(_top_cuisine_rows),
}

CROSS: dict[str, Query] = {
    "attach_coordinates": _attach,
    "location_map": _map,
    "unresolved_locations": _unresolved,
    "tier_by_location_pivot": _entities(cross.tier_by_location),
    "cuisine_by_location_quality": _entities(cross.cuisine_by_location),
}


def all_queries() -> dict[str, Query]:
    return {**SUMMARIES, **QUESTIONS, **CLEANING, **ENTITIES, **EXPLORATION, **CROSS}
