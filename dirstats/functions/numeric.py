"""Exact, order-independent arithmetic helpers.

A floating sum depends on the order in which partial results arrive, which on a
cluster changes from run to run; a mean that lands on a rounding boundary would
then flip between runs. Ratings are therefore summed as decimals of
``RATE_SCALE`` places, which hold every rating as it is printed, and divided
once at the end. Values are compared, grouped and binned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of the decimals in which ratings are summed: the shortest text of a double
#: from 0.1 to 10 billion has no more. Larger values raise an error under ANSI mode.
RATE_SCALE = 18
_SUMMED = f"decimal(28,{RATE_SCALE})"
_STEPS = 10**4
_NUMERIC = "decimal(38,12)"


def round_half_up(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, not on its binary image."""
    return F.round(value.cast(_NUMERIC), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; null when ``whole`` is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_half_up(ratio(part * 100, whole), digits)


def exact(value: Column) -> Column:
    """A double as the decimal it prints as."""
    return value.cast(_SUMMED)


def mean_of(total: Column, count: Column) -> Column:
    """Mean from a sum of ``exact`` values. Both sides are scaled up, so that sums of few
    places divide as whole numbers, rounded once."""
    return ratio(total * _STEPS, count * _STEPS)


def exact_mean(value: Column, whole: bool = True) -> Column:
    """Mean over non-null values whose sum is exact; ``whole`` for columns of integers."""
    if whole:
        return ratio(F.sum(value.cast("bigint")), F.count(value))
    return mean_of(F.sum(exact(value)), F.count(value))


def approx_median(value: Column) -> Column:
    """Median from a sketch of constant size; ``cumulative.exact_medians`` has the exact one."""
    return F.percentile_approx(value, 0.5, 10000).cast("double")


def distinct_count(value: Column, approx: bool = False) -> Column:
    return F.approx_count_distinct(value) if approx else F.count_distinct(value)
