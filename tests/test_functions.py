from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dirstats.functions import labels as L
from dirstats.functions import numeric, scores
from dirstats.functions import text as X


def apply(spark, values, dtype, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_rating_text_to_number(spark):
    values = ["3.9/5", "3.9 /5", "NEW", "-", None, "abc", "", "4.25/5", "3.9d/5", "nan"]
    parsed = apply(spark, values, "string", lambda v: X.to_number(X.rating_text(v)))
    assert parsed == [3.9, 3.9, None, None, None, None, None, 4.25, None, None]


def test_cost_text_to_number(spark):
    values = ["40", "1,200", "12,345", None, "x", "12.7"]
    parsed = apply(
        spark, values, "string", lambda v: X.to_number(X.cost_text(v)).try_cast("int")
    )
    assert parsed == [40, 1200, 12345, None, None, 12]


def test_flag(spark):
    values = ["Yes", "No", " Yes ", "maybe", None]
    assert apply(spark, values, "string", X.parse_flag) == [1, 0, None, None, None]
    assert apply(spark, values, "string", lambda v: X.parse_flag(X.strip(v)))[2] == 1


def test_strip_removes_what_python_strips(spark):
    values = [f"{c}a b{c}" for c in X.WHITESPACE] + ["  ", "", None, "a"]
    expected = [v.strip() if v is not None else None for v in values]
    assert apply(spark, values, "string", X.strip) == expected


def test_first_item_and_count(spark):
    values = ["A", "A, B", "A,,B", "A,B,", " A , B", None]
    assert apply(spark, values, "string", X.first_item) == ["A", "A", "A", "A", "A", None]
    assert apply(spark, values, "string", X.item_count) == [1, 2, 3, 3, 2, None]
    assert apply(spark, ["A::B::"], "string", lambda v: X.item_count(v, "::")) == [3]


def test_rating_label_bounds(spark):
    values = [2.9, 3.0, 3.4, 3.5, 4.0, 4.1, None]
    expected = ["Poor", "Average", "Average", "Good", "Good", "Excellent", "Unrated"]
    assert apply(spark, values, "double", L.rating_label) == expected


def test_price_tier_bounds(spark):
    values = [-5, 0, 1, 400, 401, 800, 801, None]
    expected = [None, None, "Budget", "Budget", "Mid-range", "Mid-range", "Premium", None]
    assert apply(spark, values, "int", L.price_tier) == expected


def test_bins_closed_on_the_left(spark):
    binned = apply(
        spark,
        [0, 9, 10, 20, None],
        "int",
        lambda v: L.bin_column(v, [0, 10, 20], ["low", "high"], right=False),
    )
    assert binned == ["low", "low", "high", None, None]


def test_vote_bucket_bounds(spark):
    values = [0, 10, 11, 100, 101, 500, 501, 1000, 1001, 5000, 5001, None, -1]
    digits = [v[0] for v in apply(spark, values, "bigint", L.vote_bucket)]
    assert digits == list("1122334455666")


def test_ladders(spark):
    market = apply(
        spark,
        [70.0, 69.9, 55.0, 54.9, 40.0, 39.9, None],
        "double",
        lambda v: L.at_least(v, L.MARKET_TYPES, L.MARKET_ELSE),
    )
    assert market == [
        "Heavy Delivery",
        "Balanced",
        "Balanced",
        "Dine-in Leaning",
        "Dine-in Leaning",
        "Traditional",
        "Traditional",
    ]
    performance = apply(
        spark,
        [3.9, 3.7, 3.5, 3.49, None],
        "double",
        lambda v: L.at_least(v, L.PERFORMANCE_TIERS, L.PERFORMANCE_ELSE),
    )
    assert performance == [
        "Star Performer",
        "Above Average",
        "At Par",
        "Below Average",
        "Below Average",
    ]
    gems = apply(
        spark, [4.5, 4.2, 4.1], "double", lambda v: L.at_least(v, L.GEM_TIERS, L.GEM_ELSE)
    )
    assert gems == ["Exceptional", "Excellent", "Very Good"]


def test_jump_verdict(spark):
    verdicts = apply(
        spark, [0.3, 0.25, 0.11, 0.1, None], "double", lambda v: L.jump_verdict(F.lit(False), v)
    )
    assert [v.split()[0] for v in verdicts] == ["Justified", "Marginal", "Marginal", "Not", "Not"]
    assert apply(spark, [9.0], "double", lambda v: L.jump_verdict(F.lit(True), v)) == [
        "Baseline tier"
    ]


def test_segment_of_null_flags_is_neither(spark):
    rows = spark.createDataFrame(
        [(1, 1), (1, 0), (0, 1), (0, 0), (None, 1), (1, None)], "o int, b int"
    )
    found = [r[0][0] for r in rows.select(L.service_segment(F.col("o"), F.col("b"))).collect()]
    assert found == list("123444")


def test_ordinal(spark):
    order = apply(
        spark, ["Premium", "Budget", "x", None], "string", lambda v: L.ordinal(v, L.PRICE_TIERS)
    )
    assert order == [3, 1, None, None]


def test_rounding_is_half_away_from_zero(spark):
    values = [2.5, -2.5, 0.125, 2.675, 1.005, None]
    assert apply(spark, values, "double", lambda v: numeric.round_half_up(v, 0))[:2] == [3.0, -3.0]
    assert apply(spark, values, "double", lambda v: numeric.round_half_up(v, 2))[2:] == [
        0.13,
        2.68,
        1.01,
        None,
    ]


def test_division_by_zero_is_null(spark):
    assert apply(spark, [0, 4], "int", lambda v: numeric.ratio(F.lit(2), v)) == [None, 0.5]
    assert apply(spark, [0, 3], "int", lambda v: numeric.percent(F.lit(1), v)) == [None, 33.3]


def test_scores(spark):
    row = spark.range(1).select(
        scores.credibility(F.lit(4.9), F.lit(16832)).alias("a"),
        scores.value_index(F.lit(4.4), F.lit(150)).alias("b"),
        scores.value_score(F.lit(3.5), F.lit(0.0)).alias("c"),
        scores.digital_score(F.lit(0.5), F.lit(0.1)).alias("d"),
        scores.performance_index(F.lit(4.0), F.lit(99.0)).alias("e"),
    )
    assert tuple(row.first()) == (20.71, 2.93, None, 38.0, 8.0)


def test_exact_mean_ignores_order(spark):
    values = [0.1, 0.2, 0.3, 3.3] * 7 + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    reverse = spark.createDataFrame([(v,) for v in reversed(values)], "v double")
    means = {d.agg(numeric.exact_mean(F.col("v"), whole=False)).first()[0] for d in (df, reverse)}
    assert means == {0.975}
