"""Plan shapes that have to hold when the tables are large or skewed."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from dirstats import schema as S
from dirstats.operators import cleaning, entities
from dirstats.testbed import binding, registry

QUERIES = registry.all_queries()


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("NestedLoop", "Cartesian", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan


def hot_parsed(spark, rows=30000):
    """Parsed listings of which a third belong to one entity."""
    n = F.col("id")
    hot = n % 3 == 0
    key = F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("n"), n % 5000))
    return spark.range(0, rows, 1, 8).select(
        key.alias("name"),
        (n % 2).cast("int").alias("online_order"),
        (n % 5 == 0).cast("int").alias("book_table"),
        F.when(n % 7 != 0, (n % 50) / 10).alias("rate"),
        (n * 7919 % 10007).alias("votes"),
        F.lit("North").alias("location"),
        F.lit("Cafe").alias("rest_type"),
        F.lit("Tea").alias("dish_liked"),
        F.lit("Thai").alias("cuisines"),
        (n % 1000 + 1).cast("int").alias("approx_cost"),
        F.concat(F.lit("t"), n % 4).alias("listed_type"),
        F.lit("c").alias("listed_city"),
        n.alias("ordinal"),
    )


def test_hot_entity_is_combined_before_the_shuffle(spark):
    parsed = hot_parsed(spark)
    plan = executed(entities.entities_from_parsed(parsed, ["ordinal"]))
    final = plan.split("== Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1
    assert "partial_max" in final and "partial_min" in final


def test_hot_entity_survivor_is_right(spark):
    parsed = hot_parsed(spark)
    table = entities.entities_from_parsed(parsed, ["ordinal"])
    expected = parsed.groupBy("name").agg(F.max("votes").alias("v"))
    joined = table.join(expected, "name")
    assert joined.count() == expected.count()
    assert joined.filter("votes <> v").isEmpty()
    assert table.filter("name = 'hot'").first().online_order == 0


def test_hot_entity_is_split_in_the_flag_join(spark):
    """With both sides too large to broadcast, the hot partition is read in parts."""
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    ):
        clean = cleaning.clean_parsed(hot_parsed(spark), ["ordinal"])
        plan = executed(clean)
        assert "SortMergeJoin(skew=true)" in plan
        assert clean.groupBy("name").agg(F.count_distinct("online_order").alias("n")).filter(
            "n > 1"
        ).isEmpty()


def test_dominant_cuisine_needs_no_window_over_rows(spark, sf_dir):
    plan = executed(QUERIES["q7a_dominant_cuisine"](spark, sf_dir))
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


def test_rollup_expands_only_aggregated_rows(spark, sf_dir):
    plan = executed(QUERIES["q12a_service_segments"](spark, sf_dir)).split("== Initial Plan")[0]
    below_expand = plan[plan.index("Expand") :]
    assert "HashAggregate" in below_expand[: below_expand.index("FileScan")]


@pytest.mark.parametrize(
    "name", ["eda_key_insights", "kpi_snapshot", "eda_location_summary", "location_scorecard"]
)
def test_reports_scan_the_table_once(spark, sf_dir, name):
    """Sums per group are staged where they are read more than once; those scans do not count."""
    plan = executed(QUERIES[name](spark, sf_dir)).split("== Initial Plan")[0]
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("entities-" in line or "listings-" in line for line in scans) <= 1
    assert len(scans) == 1 or all("PushedFilters" in line for line in scans)


def test_percentiles_do_not_shuffle_rows_by_rating(spark, sf_dir):
    plan = executed(QUERIES["rating_percentiles"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_units" not in plan


@pytest.mark.parametrize(
    "name", ["feature_top_cuisines", "feature_cuisine_counts", "feature_rating_labels"]
)
def test_shares_and_their_total_use_one_shuffle(spark, sf_dir, name):
    assert "ReusedExchange" in executed(QUERIES[name](spark, sf_dir))


def test_rows_are_not_shuffled_to_a_short_list_of_keys(spark, sf_dir):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="2k"):
        plan = executed(QUERIES["rows_in_active_locations"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(location" not in plan


def test_frequency_limit_is_applied_before_the_shuffle(spark, sf_dir):
    plan = executed(QUERIES["profile_frequencies"](spark, sf_dir))
    assert "WindowGroupLimit" in plan


def test_frequencies_read_the_raw_table_once(spark, sf_dir):
    plan = executed(QUERIES["profile_frequencies"](spark, sf_dir))
    assert "lineitem" not in plan and "HashAggregate" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = executed(QUERIES["q10b_gem_rarity"](spark, sf_dir))
    assert "EqualTo(price_category,Budget)" in plan
    wanted = "struct<rate:double,votes:bigint,approx_cost:int,price_category:string>"
    assert f"ReadSchema: {wanted}" in plan


def test_wide_raw_columns_are_never_read(spark, sf_dir):
    plan = executed(cleaning.parse_listings(binding.raw_listings(spark, sf_dir)).select("name"))
    assert "l_shipdate" not in plan and "l_tax" not in plan
    assert not set(S.DROPPED) & set(binding.parsed(spark, sf_dir).columns)
