from __future__ import annotations

import random

import frames
from pyspark.sql import functions as F

from dirstats.operators import joins, profile


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, `b(c)` int, d string")
    rows = [tuple(r) for r in profile.missing_profile(df).collect()]
    assert rows == [("b(c)", 2, 100.0), ("a", 1, 50.0)]
    assert profile.missing_profile(df, only_missing=False).count() == 3


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    assert [tuple(r) for r in profile.value_counts(df, "k").collect()] == [("b", 2), ("a", 1)]
    shares = {r.k: r.pct_of_total for r in profile.value_shares(df, "k").collect()}
    assert shares == {"b": 50.0, "a": 25.0, None: 25.0}


def test_frequencies_keep_each_column_limit(spark):
    rows = [(c, c * 2, str(i % 2)) for i, c in enumerate("aaabbc")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    found = profile.frequencies(df, {"x": 1, "y": 2, "z": None}).collect()
    kept = sorted((r.column_name, r.value, r.row_count) for r in found)
    assert kept == [("x", "a", 3), ("y", "aa", 3), ("y", "bb", 2), ("z", "0", 3), ("z", "1", 3)]


def test_label_order_fills_absent_labels(spark):
    df = spark.createDataFrame([("b", 2, 1.5)], "k string, n bigint, m double")
    rows = profile.in_label_order(df, "k", ["a", "b"], ["n"]).collect()
    assert [tuple(r) for r in rows] == [("a", 0, None), ("b", 2, 1.5)]


def corr_of(df, a, b):
    matrix = profile.correlation_matrix(df, ["a", "b"])
    return matrix.filter((F.col("col_a") == a) & (F.col("col_b") == b)).first().corr


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0), (9, None)], "a int, b double")
    assert corr_of(df, "a", "b") == 1.0 == corr_of(df, "b", "a") == corr_of(df, "a", "a")


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "a int, b double")
    assert corr_of(df, "a", "b") is None and corr_of(df, "a", "a") is None
    assert corr_of(df.limit(1), "a", "b") is None


def test_constant_stays_constant_when_partial_results_merge(spark):
    df = spark.range(0, 10007, 1, 7).select(
        (F.col("id") % 101).alias("a"), F.lit(2).alias("b"), F.when(F.col("id") > 5, 1).alias("c")
    )
    for complete in ((), ("a", "b")):
        matrix = profile.correlation_matrix(df, ["a", "b", "c"], complete).collect()
        assert {(r.col_a, r.col_b): r["corr"] for r in matrix if r["corr"] is not None} == {
            ("a", "a"): 1.0
        }


def test_target_correlations_by_strength(spark):
    rows = [(1, 1, -5), (2, 2, 1), (3, 3, -2), (4, 5, -9)]
    df = spark.createDataFrame(rows, "t int, up int, down int")
    ranked = profile.target_correlations(profile.correlation_matrix(df, ["t", "up", "down"]), "t")
    found = [(r.column_name, r.direction, r.strength) for r in ranked.collect()]
    assert found == [("up", "positive", "strong"), ("down", "negative", "strong")]


def test_value_range(spark):
    df = spark.createDataFrame([(v,) for v in [4, 1, 1, 2, None]], "v int")
    assert tuple(profile.value_range(df, "v").first()) == (1, 4, 2.0, 1.5)
    assert tuple(profile.value_range(df.limit(0), "v").first()) == (None, None, None, None)
    assert profile.value_range(df, "v", approx=True).first().median in (1.0, 2.0)


def test_preview(spark):
    assert profile.preview(spark.range(10)).count() == 5


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, "x", 1), ("a", "x", 2)], "k string, l string, v int")
    right = spark.createDataFrame([(None, "x", 7), ("b", "x", 8)], "k string, l string, w int")
    rows = joins.null_safe_join(left, right, ["k", "l"]).orderBy("v").collect()
    assert [(r.k, r.v, r.w) for r in rows] == [(None, 1, 7), ("a", 2, None)]
    both = joins.null_safe_join(left, right, ["k", "l"], "full").collect()
    assert sorted(((r.k or ""), r.v, r.w) for r in both if r.k) == [("a", 2, None), ("b", None, 8)]


def test_key_filters(spark):
    df = spark.createDataFrame([(k,) for k in [*"aaabbc", None, None, None, None]], "k string")
    active = joins.keep_keys(df, joins.keys_with_at_least(df, "k", 2))
    assert sorted(frames.column(active, "k")) == list("aaabb")
    top = joins.keep_keys(df, joins.most_frequent_keys(df, "k", 1))
    assert frames.column(top, "k") == ["a", "a", "a"]
    dim = spark.createDataFrame([("a",)], "k string")
    assert sorted(frames.column(joins.missing_keys(df, dim, "k"), "k")) == ["b", "c"]


def test_correlations_have_the_same_bits_however_rows_are_spread(spark, sf_dir):
    rng = random.Random(11)
    rows = [(rng.gauss(3, 1), rng.random() * 1e6, rng.choice([None, 1, 2])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    exact = [
        profile.correlation_matrix(df.repartition(n), ["a", "b", "c"], digits=12).orderBy("col_a", "col_b").collect()
        for n in (1, 64)
    ]
    assert exact[0] == exact[1]
    built_in = df.agg(F.corr("a", "b")).first()[0]
    found = {(r.col_a, r.col_b): r["corr"] for r in exact[0]}
    assert abs(found["a", "b"] - built_in) < 1e-9
