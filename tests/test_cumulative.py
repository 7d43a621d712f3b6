"""Running sums by ranges against plain Python, and the plans of the reports that use them."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dirstats.operators import cumulative as C
from dirstats.operators.ranking import histogram, share_below
from dirstats.testbed import registry

SF = "/root/testdata/sf0.001"


def values_of(n=2000, seed=3):
    rng = random.Random(seed)
    hot = [7.25] * (n // 3)
    return hot + [round(rng.gauss(0, 50), 3) for _ in range(n - len(hot))] + [None] * 5


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 2, 9, 200])
def test_running_sums(spark, descending, ranges):
    rows = [(g, v) for g in ("a", "b", None) for v in values_of(300, len(g or ""))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = C.running_sums(counts, "v", "n", by=["g"], descending=descending, ranges=ranges)
    seen = {(r.g, r.v): (r._before, r._whole) for r in got.collect()}
    for g in ("a", "b", None):
        mine = [v for h, v in rows if h == g]
        for v in set(mine):
            if v is None:
                before = len([x for x in mine if x is not None])
            else:
                before = sum(x is not None and (x > v if descending else x < v) for x in mine)
            assert seen[g, v] == (before, len(mine))
    assert len(seen) == len(set(rows))


@pytest.mark.parametrize("rows", [[1, 2, 3, 4], [5], [None, 2], [], [None], [2, 2, 2, 9], [1, 9]])
def test_exact_median(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v int")
    known = [r for r in rows if r is not None]
    expected = float(statistics.median(known)) if known else None
    assert C.exact_medians(C.value_counts_of(df, "v"), "v").first()[0] == expected


def test_exact_medians_by_group(spark):
    rng = random.Random(1)
    rows = [(k % 4 or None, rng.choice([rng.random(), 0.5])) for k in range(999)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    found = C.exact_medians(C.value_counts_of(df, "v", ["g"]), "v", by=["g"]).collect()
    expected = {g: statistics.median([v for h, v in rows if h == g]) for g in {g for g, _ in rows}}
    assert {r.g: r.median for r in found} == expected


def test_median_of_a_million_values_uses_no_buffer(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 16).select(((F.col("id") * 7919) % n + 0.25).alias("v"))
    median = C.exact_medians(C.value_counts_of(df, "v"), "v")
    assert median.first()[0] == (n - 1) / 2 + 0.25
    plan = median._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    placed = C.running_sums(C.value_counts_of(df, "v"), "v", "_n")
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < n


def test_ranks_with_ties(spark):
    values = values_of(400)
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(7)
    got = C.with_ranks(df, {"up": ("v", False), "down": ("v", True)}).collect()
    known = [v for v in values if v is not None]
    assert len(got) == len(values)
    for r in got:
        lower = len(known) if r.v is None else sum(x < r.v for x in known)
        higher = len(known) if r.v is None else sum(x > r.v for x in known)
        assert (r.up, r.down) == (lower + 1, higher + 1)


def test_share_below_of_continuous_values(spark):
    values = [v for v in values_of(1500) if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "rate double").repartition(4)
    got = {r._units: r.beats_pct for r in share_below(df).collect()}
    below = Counter(values)
    run = 0
    for v in sorted(below):
        assert abs(got[v] - run * 100 / len(values)) <= 0.05 + 1e-9
        run += below[v]
    assert len(got) == len(below)


@pytest.mark.parametrize("bins", [1, 7, 25])
def test_histogram_of_continuous_values(spark, bins):
    values = [v for v in values_of(900) if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "rate double").repartition(4)
    rows = histogram(df, "rate", bins).orderBy("bin").collect()
    low, high = min(values), max(values)
    step = (high - low) / bins
    expected = Counter(min(int((v - low) / step + 1e-12), bins - 1) + 1 for v in values)
    assert [r.row_count for r in rows] == [expected[i] for i in range(1, bins + 1)]


def test_histogram_without_values(spark):
    assert histogram(spark.createDataFrame([(None,)], "rate double"), "rate", 5).count() == 0


@pytest.mark.parametrize(
    "name",
    [
        "sum_07_cost_range", "eda_cost_summary", "q4_location_leaderboard", "q6_digital_adoption",
        "q7b_dominance_summary", "q8a_cuisine_popularity", "q8b_cuisine_quality",
        "cuisine_rank_gap", "location_scorecard", "rating_percentiles", "eda_rating_histogram",
        "eda_location_summary",
    ],
)
def test_no_window_over_all_groups(spark, name):
    """A window without a partition key sees the sums of the ranges or rows after a limit."""
    plan = registry.all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().split("\n")
    for line, child in zip(lines, [*lines[1:], ""], strict=True):
        if " Window [" not in f" {line}":
            continue
        first = line.split("windowspecdefinition(")[1].split(",")[0]
        if " ASC" in first or " DESC" in first or "specifiedwindowframe" in first:
            assert "_at#" in line or "_sum#" in line or "Limit" in child, line
