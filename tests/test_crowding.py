"""Grouping by entity keys of which some are crowded: the same rows, and tasks that stay small."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dirstats import schema as S
from dirstats.operators import cleaning, crowding, entities
from dirstats.operators.cleaning import with_features
from dirstats.testbed import binding, registry

PLAIN, SMALL = 10**9, 500


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    """6,000 written rows: a third of one entity, null names, null flags, repeated rows and places."""
    n = F.col("id") % 5500
    hot = n % 3 == 0
    name = F.when(hot, F.lit("hot")).when(n % 11 != 0, F.concat(F.lit("n"), n % 1300))
    rows = spark.range(0, 6000, 1, 6).select(
        name.alias("name"),
        F.when(n % 5 != 0, (n % 2).cast("int")).alias("online_order"),
        (n % 4 == 0).cast("int").alias("book_table"),
        F.when(n % 7 != 0, (n % 50) / 10).alias("rate"),
        F.when(n % 9 != 0, n * 7919 % 10007).alias("votes"),
        F.when(n % 100 != 0, F.concat(F.lit("l"), n % 2)).alias("location"),
        F.when(n % 97 != 0, F.lit("Cafe")).alias("rest_type"),
        F.lit("Tea").alias("dish_liked"),
        F.lit("Thai").alias("cuisines"),
        (n % 1000 + 1).cast("int").alias("approx_cost"),
        F.concat(F.lit("t"), n % 4).alias("listed_type"),
        F.lit("c").alias("listed_city"),
        (n * 31 % 5500).alias("ordinal"),
    )
    path = str(tmp_path_factory.mktemp("crowding") / "parsed")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def counted(df):
    return Counter(df.collect())


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def uncrowded(parsed):
    return parsed.filter("name <> 'hot'")


def in_map_tasks(plan):
    """The part of a final plan below its only exchange by key."""
    assert plan.count("Exchange hashpartitioning(name") == plan.count("Exchange hashpartitioning") == 1
    return plan[plan.index("Exchange hashpartitioning") :]


def test_the_rows_of_a_key_stay_together(parsed):
    crowded, rest = crowding.split_crowded(parsed, S.ENTITY_KEYS, SMALL)
    sides = [{(r.name, r.location) for r in side.collect()} for side in (crowded, rest)]
    assert {k for k in sides[0] if k[0] == "hot"} and not sides[0] & sides[1]
    assert len(sides[0]) < 10 < len(sides[1])
    assert counted(crowded.unionByName(rest)) == counted(parsed)
    assert crowding.split_crowded(parsed, S.ENTITY_KEYS, PLAIN)[1] is None
    assert crowding.split_crowded(uncrowded(parsed).dropna(), S.ENTITY_KEYS, SMALL)[0] is None
    assert crowding.split_crowded(parsed.limit(0), S.ENTITY_KEYS, SMALL)[1] is None


@pytest.mark.parametrize("keep_order", [False, True])
def test_cleaning_gives_the_same_rows(parsed, keep_order):
    plain, split = (
        cleaning.clean_parsed(parsed, ["ordinal"], keep_order=keep_order, task_rows=rows)
        for rows in (PLAIN, SMALL)
    )
    assert plain.columns == split.columns and "Union" in final_plan(split)
    assert plain.count() < parsed.count() and counted(plain) == counted(split)


def test_cleaning_has_one_shuffle_and_holds_nothing_before_it(parsed):
    """Before there were four, and each task aggregated all rows that it had read."""
    clean = cleaning.clean_parsed(uncrowded(parsed).dropna(), ["ordinal"], task_rows=SMALL)
    below = in_map_tasks(final_plan(clean))
    assert "Aggregate" not in below and "Sort " not in below and "Join" not in final_plan(clean)


def test_means_need_no_further_shuffle(parsed):
    rows = uncrowded(parsed).dropna()
    clean = cleaning.clean_parsed(rows, ["ordinal"], keep_order=True, task_rows=SMALL)
    table = entities.dedup_entities(with_features(clean), strategy="mean", order="_order")
    assert "Aggregate" not in in_map_tasks(final_plan(table))


def test_entity_tables_give_the_same_rows(parsed):
    tables = [
        entities.entities_from_parsed(parsed, ["ordinal"], task_rows=rows) for rows in (PLAIN, SMALL)
    ]
    assert counted(tables[0]) == counted(tables[1])
    listings = with_features(cleaning.clean_parsed(parsed, ["ordinal"]))
    tables += [entities.dedup_entities(listings, task_rows=rows) for rows in (PLAIN, SMALL)]
    assert all(counted(t.select(tables[0].columns)) == counted(tables[0]) for t in tables[2:])
    assert "Union" in final_plan(tables[1]) and "Union" in final_plan(tables[3])


def test_entity_tables_hold_nothing_before_the_shuffle(parsed):
    rows = uncrowded(parsed).dropna()
    direct = entities.entities_from_parsed(rows, ["ordinal"], task_rows=SMALL)
    survivors = entities.dedup_entities(rows, task_rows=SMALL)
    for table in (direct, survivors):
        below = in_map_tasks(final_plan(table))
        assert "Aggregate" not in below and "Sort " not in below


def test_crowded_entity_is_combined_before_the_shuffle(parsed):
    hot = parsed.filter("name = 'hot' AND location = 'l0'")
    table = entities.entities_from_parsed(hot, ["ordinal"], task_rows=SMALL)
    assert crowding.split_crowded(hot, S.ENTITY_KEYS, SMALL)[0] is not None
    plan = final_plan(table)
    assert "partial_max" in plan[: plan.index("FileScan")] and table.count() == 1


def test_raw_rows_are_joined_and_sorted_while_narrow(spark, sf_dir):
    plan = binding.raw_listings(spark, sf_dir, in_order=True)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert "/listing/" in text[: text.index("Sort [")] and "/listing/" not in text[text.index("Sort [") :]
    assert text.index("Join Inner, (s_nationkey") < text.index("Join Inner, (l_partkey")
    places = binding.raw_listings(spark, "/root/testdata/sf0.001", in_order=True).select(*binding.INGEST_ORDER)
    found = [tuple(r) for r in places.collect()]
    assert found == sorted(found)


@pytest.mark.parametrize("name", ["csv_listings", "csv_clean_listings"])
def test_csv_copies_are_compressed(spark, monkeypatch, name):
    paths = []
    through = registry._through_csv
    monkeypatch.setattr(registry, "_through_csv", lambda *a, **k: paths.append(through(*a, **k)) or paths[-1])
    registry.all_queries()[name](spark, "/root/testdata/sf0.001")
    files = spark.read.text(paths).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)
