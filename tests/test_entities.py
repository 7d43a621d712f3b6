from __future__ import annotations

import frames
import pytest
from pyspark.sql import functions as F

from dirstats.operators import entities as E
from dirstats.testbed import registry


@pytest.fixture(scope="module")
def table(spark):
    return frames.listings(
        spark,
        {"name": "A", "votes": 5, "rate": 3.0, "listed_type": "x"},
        {"name": "A", "votes": 9, "rate": 4.0, "listed_type": "y"},
        {"name": "A", "votes": 9, "rate": 4.1, "listed_type": "z"},
        {"name": "A", "location": "South", "votes": 1},
        {"name": None, "votes": None},
        {"name": None, "votes": 2},
    )


def test_max_votes_survivor(table):
    rows = {(r.name, r.location): r for r in E.dedup_entities(table).collect()}
    assert len(rows) == 3
    assert (rows["A", "North"].votes, rows["A", "North"].rate) == (9, 4.1)
    assert rows[None, "North"].votes == 2
    assert "listed_type" not in E.dedup_entities(table).columns


def test_all_null_votes_keeps_one_row(spark):
    df = frames.listings(spark, {"votes": None, "rate": 3.1}, {"votes": None, "rate": 3.2})
    assert frames.column(E.dedup_entities(df), "rate") == [3.2]


def test_mean_strategy(spark):
    df = frames.listings(
        spark,
        {"votes": 1, "rate": 3.1, "listed_city": None, "dish_liked": "first"},
        {"votes": 2, "rate": None, "listed_city": "B", "dish_liked": "second"},
        {"name": None},
    ).withColumn("_order", F.col("votes"))
    out = E.dedup_entities(df, strategy="mean", order="_order")
    row = out.first()
    assert out.count() == 1
    assert (row.votes, row.rate, row.listed_city, row.dish_liked) == (1.5, 3.1, "B", "first")


def test_unknown_strategy(table):
    with pytest.raises(ValueError, match="unknown strategy"):
        E.dedup_entities(table, strategy="median")
    with pytest.raises(ValueError, match="order"):
        E.dedup_entities(table, strategy="mean")


def test_reports(table):
    assert tuple(E.duplication_report(table).first()) == (6, 3, 3, 2.0)
    sizes = [(r.listings, r.entities) for r in E.size_distribution(table).collect()]
    assert sizes == [(1, 1), (3, 1)]
    assert frames.column(E.most_duplicated(table), "listed_type") == ["x", "y", "z"]
    spread = {r.column_name: tuple(r)[1:] for r in E.consistency_report(table).collect()}
    assert spread == {"votes": (1, 4.0), "rate": (1, 1.1)}


def test_spot_check(spark, table):
    table = E.dedup_entities(table)
    expected = spark.createDataFrame(
        [("A", "North", 9), ("A", "South", 7), ("Z", "North", 1)],
        "name string, location string, votes bigint",
    )
    verdicts = {(r.name, r.location): r.matches for r in E.spot_check(table, expected).collect()}
    assert verdicts == {("A", "North"): True, ("A", "South"): False, ("Z", "North"): False}


def test_named_rows(table):
    rows = E.named_rows(table, ["A"], ["name", "votes"])
    assert sorted(frames.column(rows, "votes")) == [1, 5, 9, 9]


def test_reconcile(table):
    unique = E.dedup_entities(table).filter("location = 'North'")
    rows = E.reconcile(table, unique, ["name", "location"], ["votes"], ("listing", "entity"))
    found = {(r.name, r.location): r for r in rows.collect()}
    assert found["A", "North"].votes_difference == 14
    assert found["A", "North"].rows_difference == 2
    assert found["A", "South"].entity_rows == 0
    assert found[None, "North"].listing_rows == 2


def test_ratings_of_many_places_are_exact(spark):
    from dirstats.operators import ranking, sums

    rates = [3.7] * 49 + [3.8] * 59 + [3.6]
    many = frames.listings(spark, *[{"rate": r} for r in rates])
    mean = E.dedup_entities(many.withColumn("_o", F.lit(1)), strategy="mean", order="_o")
    assert mean.first().rate == pytest.approx(sum(rates) / len(rates), abs=1e-12)
    odd = frames.listings(spark, {"rate": 3.744954}, {"rate": 3.744954, "name": "B"})
    assert sums.group_sums(odd, ["location"]).select(sums.avg_rating()).first()[0] == 3.74
    close = frames.listings(spark, {"rate": 3.00001}, {"rate": 3.00004}, {"rate": 3.5})
    shares = ranking.with_share_below(close, close).orderBy("rate")
    assert frames.column(shares, "beats_pct") == [0.0, 33.3, 66.7]
    spread = E.consistency_report(frames.listings(spark, {"rate": 3.00001}, {"rate": 3.00002}))
    assert {r.column_name: r.inconsistent_entities for r in spread.collect()}["rate"] == 1


def test_mean_keeps_columns_of_any_name(spark):
    df = frames.listings(spark, {}).withColumns({"_mine": F.lit(2.5), "_o": F.lit(1)})
    out = E.dedup_entities(df, strategy="mean", order="_o")
    assert "_mine" in out.columns and "_o" not in out.columns


def test_spot_check_query_finds_a_wrong_survivor(spark, sf_dir, monkeypatch):
    right = registry.binding.entities(spark, sf_dir)
    check = registry.ENTITIES["entity_spot_check"]
    rows = check(spark, sf_dir).collect()
    assert rows and all(r.matches for r in rows)
    first = (F.col("name") == rows[0].name) & (F.col("location") == rows[0].location)
    wrong = right.withColumn("votes", F.when(first, F.col("votes") - 1).otherwise(F.col("votes")))
    monkeypatch.setattr(registry.binding, "entities", lambda *_: wrong)
    found = {(r.name, r.location): r.matches for r in check(spark, sf_dir).collect()}
    assert found == {(r.name, r.location): r is not rows[0] for r in rows}
