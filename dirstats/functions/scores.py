"""Derived scores as reusable Column functions.

Row scores take row columns; group scores take the group's (unrounded) means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ratio, round_half_up


def credibility(rate: Column, votes: Column) -> Column:
    """Rating weighted by the order of magnitude of its vote count (base 10)."""
    return round_half_up(rate * F.log10(votes + 1), 2)


def value_index(rate: Column, cost: Column) -> Column:
    return round_half_up(ratio(rate * 100, cost), 2)


def value_score(mean_rate: Column, mean_cost: Column) -> Column:
    return round_half_up(ratio(mean_rate * 100, mean_cost), 3)


def digital_score(online_share: Column, booking_share: Column) -> Column:
    return round_half_up(online_share * 70 + booking_share * 30, 1)


def performance_index(mean_rate: Column, mean_votes: Column) -> Column:
    return round_half_up(mean_rate * F.log10(mean_votes + 1), 2)
