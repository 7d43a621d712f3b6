"""Label ladders. All are native expressions; none needs a Python function."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label vocabularies, in report order.
PRICE_TIERS = ("Budget", "Mid-range", "Premium")
PRICE_EDGES = (0, 400, 800, None)
RATING_LABELS = ("Excellent", "Good", "Average", "Poor", "Unrated")
QUALITY_LABELS = ("Good", "Excellent")
VOTE_RANGES = (
    (0, 10, "1. Minimal   (0 – 10)"),
    (11, 100, "2. Low       (11 – 100)"),
    (101, 500, "3. Moderate  (101 – 500)"),
    (501, 1000, "4. Good      (501 – 1,000)"),
    (1001, 5000, "5. High      (1,001 – 5,000)"),
)
VOTE_TOP = "6. Very High  (5,001+)"
MARKET_TYPES = ((70, "Heavy Delivery"), (55, "Balanced"), (40, "Dine-in Leaning"))
MARKET_ELSE = "Traditional"
PERFORMANCE_TIERS = ((3.9, "Star Performer"), (3.7, "Above Average"), (3.5, "At Par"))
PERFORMANCE_ELSE = "Below Average"
GEM_TIERS = ((4.5, "Exceptional"), (4.2, "Excellent"))
GEM_ELSE = "Very Good"
DIGITAL_VERDICTS = ((3.9, "Strong signal"), (3.75, "Moderate signal"), (3.6, "Weak signal"))
DIGITAL_ELSE = "No signal"
JUMP_VERDICTS = (
    (0.25, "Justified — large quality gain"),
    (0.10, "Marginal — small quality gain"),
)
JUMP_FIRST = "Baseline tier"
JUMP_ELSE = "Not justified — minimal quality gain"
SERVICE_TYPES = ("Online Ordering", "Dine-in Only")
SEGMENTS = ("1. Both Services", "2. Online Only", "3. Table Only", "4. Neither")
BENCHMARK_SEGMENT = "— Platform Average"
BENCHMARK_VERDICT = "Benchmark"


def ladder(
    cases: Iterable[tuple[Column, str | int]], otherwise: str | None = None
) -> Column:
    """First case whose condition holds; null if none does and ``otherwise`` is not given."""
    steps = [(condition, F.lit(label)) for condition, label in cases]
    result = F.when(*steps[0])
    for condition, label in steps[1:]:
        result = result.when(condition, label)
    return result if otherwise is None else result.otherwise(F.lit(otherwise))


def at_least(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First step whose floor ``value`` reaches; null falls to ``otherwise``."""
    return ladder([(value >= F.lit(floor), label) for floor, label in steps], otherwise)


def _inside(value: Column, low: float | None, high: float | None, right: bool) -> Column:
    inside = value.isNotNull()
    if low is not None:
        inside = inside & ((value > F.lit(low)) if right else (value >= F.lit(low)))
    if high is not None:
        inside = inside & ((value <= F.lit(high)) if right else (value < F.lit(high)))
    return inside


def bin_column(
    value: Column,
    edges: Sequence[float | None],
    labels: Sequence[str],
    right: bool = True,
) -> Column:
    """Half-open bins, closed on the right by default; ``None`` is unbounded."""
    bins = zip(edges[:-1], edges[1:], labels, strict=True)
    return ladder([(_inside(value, low, high, right), label) for low, high, label in bins])


def bucketize(value: Column, ranges: Sequence[tuple[int, int, str]], otherwise: str) -> Column:
    """Closed ranges; everything else, null included, gets ``otherwise``."""
    return ladder([(value.between(low, high), label) for low, high, label in ranges], otherwise)


def price_tier(cost: Column) -> Column:
    return bin_column(cost, PRICE_EDGES, PRICE_TIERS)


def rating_label(rate: Column) -> Column:
    return (
        F.when(rate.isNull(), F.lit("Unrated"))
        .when(rate < 3.0, F.lit("Poor"))
        .when(rate < 3.5, F.lit("Average"))
        .when(rate <= 4.0, F.lit("Good"))
        .otherwise(F.lit("Excellent"))
    )


def vote_bucket(votes: Column) -> Column:
    return bucketize(votes, VOTE_RANGES, VOTE_TOP)


def service_type(online: Column) -> Column:
    return F.when(online == 1, F.lit(SERVICE_TYPES[0])).otherwise(F.lit(SERVICE_TYPES[1]))


def service_segment(online: Column, booking: Column) -> Column:
    both, online_only, table_only, neither = SEGMENTS
    return (
        F.when((online == 1) & (booking == 1), F.lit(both))
        .when((online == 1) & (booking == 0), F.lit(online_only))
        .when((online == 0) & (booking == 1), F.lit(table_only))
        .otherwise(F.lit(neither))
    )


def jump_verdict(is_first: Column, jump: Column) -> Column:
    steps = [(jump > F.lit(floor), label) for floor, label in JUMP_VERDICTS]
    return ladder([(is_first, JUMP_FIRST), *steps], JUMP_ELSE)


def correlation_strength(value: Column) -> Column:
    return (
        F.when(F.abs(value) > 0.3, F.lit("strong"))
        .when(F.abs(value) > 0.1, F.lit("moderate"))
        .when(value.isNotNull(), F.lit("weak"))
    )


def ordinal(value: Column, labels: Sequence[str]) -> Column:
    """Position of a label in a fixed order, from 1; unknown labels are null."""
    return ladder([(value == label, position) for position, label in enumerate(labels, 1)])
