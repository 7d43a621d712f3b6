from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dirstats.operators import ranking as R


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_ntile_formula_equals_window(spark, n):
    w = W.orderBy("id")
    rows = spark.range(n).select(
        F.ntile(3).over(w).alias("expected"),
        R.ntile_of(F.row_number().over(w).cast("bigint"), F.lit(n), 3).alias("found"),
    )
    assert all(r.expected == r.found for r in rows.collect())


def skewed(spark, n=3000):
    """A third of the rows share one sort value."""
    rng = random.Random(7)
    values = [0 if i % 3 == 0 else rng.randrange(50) for i in range(n)]
    return spark.createDataFrame(list(enumerate(values)), "id bigint, v int").repartition(7)


def test_global_row_number_and_ntile(spark):
    df = skewed(spark)
    order = [F.desc("v"), F.col("id")]
    w = W.orderBy(*order)
    expected = df.select("id", F.row_number().over(w).alias("n"), F.ntile(4).over(w).alias("t"))
    numbered = R.global_row_number(df, order, "found").join(expected, "id")
    assert numbered.filter("found <> n").isEmpty() and numbered.count() == 3000
    bucketed = R.global_ntile(df, order, 4, "found").join(expected, "id")
    assert bucketed.filter("found <> t").isEmpty()


def test_a_hot_sort_value_is_split_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = R.stage_in_order(skewed(spark), [F.desc("v"), F.col("id")])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in staged.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert staged.filter("v = 0").select("_part").distinct().count() > 1


def test_top_ranked_has_competition_ranks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 1)], "k string, v int")
    rows = R.top_ranked(df, F.desc("v"), [F.col("k")], 3, "rank").orderBy("k").collect()
    assert [(r.k, r["rank"]) for r in rows] == [("a", 1), ("b", 1), ("c", 3)]


def test_share_below_equals_brute_force(spark):
    values = [1.0, 2.0, 2.0, 3.5, 3.5, 3.5, 4.9, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, rate double")
    rated = [v for v in values if v is not None]
    found = {r.i: r.beats_pct for r in R.with_share_below(df, df).collect()}
    for i, v in enumerate(values):
        expected = (
            None if v is None else round(sum(x < v for x in rated) * 100 / len(rated) + 1e-9, 1)
        )
        assert found[i] == expected


def bins(df):
    return [r.row_count for r in df.orderBy("bin").collect()]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.5, 2.0, 2.9, 3.0, None]], "rate double")
    assert bins(R.histogram(df, "rate", 4)) == [1, 1, 1, 2]
    edges = [(r.bin_from, r.bin_to) for r in R.histogram(df, "rate", 4).orderBy("bin").collect()]
    assert edges == [(1.0, 1.5), (1.5, 2.0), (2.0, 2.5), (2.5, 3.0)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "rate double")
    counts = bins(R.histogram(df, "rate", 25))
    assert counts[12] == 2 and sum(counts) == 2
