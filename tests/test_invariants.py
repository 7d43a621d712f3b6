"""Numbers that must agree between queries on the bound test tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dirstats.testbed import binding
from dirstats.testbed.registry import all_queries

Q = all_queries()


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: Q[name](spark, sf_dir)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_parts_add_up_to_the_entity_count(run):
    n = run("sum_01_total").first()[0]
    assert total(run("q2_rating_crosstab"), "total_restaurants") == n
    assert total(run("q3_vote_buckets"), "total_restaurants") == n
    assert total(run("q11b_tier_composition"), "restaurant_count") == n
    assert total(run("q12b_service_by_tier"), "total_in_tier") == n
    segments = run("q12a_service_segments")
    benchmark = segments.filter("digital_verdict = 'Benchmark'").first()
    assert benchmark.total_restaurants == n
    assert total(segments.filter("digital_verdict <> 'Benchmark'"), "total_restaurants") == n


def test_unrated_agrees_everywhere(run):
    unrated = run("sum_06_unrated").first().unrated_count
    assert total(run("q2_rating_crosstab"), "unrated_count") == unrated
    assert total(run("q3_vote_buckets"), "unrated_count") == unrated


def test_every_location_is_won_once(run):
    locations = run("sum_02_locations").first()[0]
    wins = run("q7b_dominance_summary")
    if wins.count() < 10:
        assert total(wins, "locations_dominated") == locations


def test_shared_locations_have_one_size(run):
    a = run("q4_location_leaderboard").select("location", "total_restaurants")
    b = run("q7a_dominant_cuisine").select("location", F.col("total_restaurants").alias("other"))
    joined = a.join(b, "location")
    assert joined.count() > 0
    assert joined.filter("total_restaurants <> other").isEmpty()


def test_both_roads_to_the_entity_table(run, spark, sf_dir):
    steps = run("entity_dedup_max_votes")
    direct = binding.entities(spark, sf_dir).select(*steps.columns)
    assert steps.exceptAll(direct).isEmpty() and direct.exceptAll(steps).isEmpty()


def test_distributed_ntile_agrees_with_the_report(run):
    report = run("q10a_hidden_gems").select("name", "location", "proof_bucket")
    everything = run("gem_proof_buckets").withColumnRenamed("proof_bucket", "other")
    joined = report.join(everything, ["name", "location"])
    assert joined.count() == report.count()
    assert joined.filter("proof_bucket <> other").isEmpty()
