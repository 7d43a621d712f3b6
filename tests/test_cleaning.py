from __future__ import annotations

import frames
from pyspark.sql import functions as F

from dirstats import schema as S
from dirstats.operators import cleaning
from dirstats.operators.entities import dedup_entities, entities_from_parsed

COST = "approx_cost(for two people)"


def clean(df):
    return cleaning.clean_listings(df, ["ordinal"])


def test_clean_schema_and_values(spark):
    df = frames.raw(
        spark,
        {"name": " Cafe\t", COST: "1,200", "rate": "4.1 /5", "dish_liked": " Tea "},
        {"name": "Bar", "rate": "NEW", "dish_liked": None},
    )
    cleaned = clean(df)
    assert [(f.name, f.dataType) for f in cleaned.schema] == [
        (f.name, f.dataType) for f in S.CLEAN
    ]
    rows = {r.name: r for r in cleaned.collect()}
    assert rows["Cafe"].approx_cost == 1200 and rows["Cafe"].rate == 4.1
    assert rows["Cafe"].dish_liked == "Tea"
    assert rows["Bar"].rate is None and rows["Bar"].dish_liked == "Not Available"


def test_incomplete_rows_are_dropped(spark):
    df = frames.raw(
        spark,
        {"name": "ok"},
        {"name": "no cost", COST: None},
        {"name": "bad cost", COST: "x"},
        {"name": "no type", "rest_type": None},
        {"name": "no cuisine", "cuisines": None},
        {"name": "no location", "location": None},
        {"name": "no rate", "rate": None},
    )
    assert sorted(frames.column(clean(df), "name")) == ["no rate", "ok"]
    report = cleaning.null_drop_report(cleaning.parse_listings(df)).first()
    assert tuple(report) == (7, 5, 71.43, 2)


def test_flags_follow_the_first_raw_row(spark):
    df = frames.raw(
        spark,
        {"online_order": "No", "book_table": "maybe", COST: None},
        {"online_order": "Yes", "book_table": "Yes", "listed_in(type)": "Buffet"},
        {"online_order": "Yes", "book_table": "Yes", "listed_in(type)": "Pubs"},
    )
    rows = clean(df).collect()
    assert {(r.online_order, r.book_table) for r in rows} == {(0, 0)}
    assert sorted(r.listed_type for r in rows) == ["Buffet", "Pubs"]


def test_distinct_runs_before_flags_are_replaced(spark):
    """Rows that differ in a flag only stay two rows, then look alike."""
    df = frames.raw(spark, {"online_order": "No"}, {"online_order": "Yes"}, {"online_order": "Yes"})
    rows = clean(df).collect()
    assert len(rows) == 2 and {r.online_order for r in rows} == {0}


def test_null_name_keeps_its_flags(spark):
    df = frames.raw(spark, {"name": None, "online_order": "Yes"}, {"name": "x"})
    rows = {r.name: r.online_order for r in clean(df).collect()}
    assert rows == {None: 1, "x": 1}


def test_features(spark):
    df = cleaning.with_features(clean(frames.raw(spark, {"cuisines": " Thai , Asian,"})))
    row = df.first()
    assert df.columns == S.LISTING.fieldNames()
    assert (row.price_category, row.rating_label) == ("Mid-range", "Good")
    assert (row.primary_cuisine, row.cuisine_count) == ("Thai", 3)


def test_duplicate_report(spark):
    df = spark.createDataFrame(
        [(1, None), (1, None), (1, ""), (2, "x"), (2, "x"), (2, "x")], "a int, b string"
    )
    assert tuple(cleaning.duplicate_report(df).first()) == (6, 3, 50.0, 3)
    assert tuple(cleaning.duplicate_report(df, by_digest=True).first()) == (6, 3, 50.0, 3)
    assert tuple(cleaning.duplicate_report(df, ["a"]).first()) == (6, 4, 66.67, 2)
    assert tuple(cleaning.duplicate_report(df.limit(0)).first()) == (0, 0, None, 0)


def test_reject_report(spark):
    df = frames.raw(
        spark,
        {"rate": "abc", COST: "x", "online_order": "maybe"},
        {"rate": "NEW", COST: None},
        {},
    )
    found = {r.column_name: r.rejected for r in cleaning.reject_report(df).collect()}
    assert found == {"rate": 1, "approx_cost": 1, "online_order": 1, "book_table": 0}


def test_entities_in_one_shuffle_equal_the_staged_steps(spark):
    df = frames.raw(
        spark,
        {"votes": 5, "online_order": "No", COST: None},
        {"votes": 7, "listed_in(type)": "Buffet"},
        {"votes": 7, "rate": "4.4/5"},
        {"votes": 7, "rate": "4.4/5"},
        {"name": None, "votes": 1},
        {"name": None, "votes": 3, "rate": "-"},
        {"name": "gone", "rest_type": None},
        {"location": "South", "book_table": "Yes"},
    )
    parsed = cleaning.parse_listings(df)
    direct = entities_from_parsed(parsed, ["ordinal"])
    steps = dedup_entities(cleaning.with_features(cleaning.clean_parsed(parsed, ["ordinal"])))
    steps = steps.select(*direct.columns)
    assert direct.count() == 3
    assert direct.exceptAll(steps).isEmpty() and steps.exceptAll(direct).isEmpty()


def test_order_columns_of_several_files(spark):
    """A compound ordinal decides by its first differing part."""
    df = frames.raw(spark, {"online_order": "No"}, {"online_order": "Yes"})
    ordered = df.withColumn("file", -F.col("ordinal"))
    rows = cleaning.clean_listings(ordered, ["file", "ordinal"]).collect()
    assert {r.online_order for r in rows} == {1}
