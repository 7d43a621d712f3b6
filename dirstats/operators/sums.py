"""Additive sums per group, and the metrics derived from them.

Every metric of the reports is a ratio of counts and integer sums. A report
therefore makes one hash aggregation over the base table (``group_sums``), and
reads totals, shares and benchmark rows from that small frame. Because sums
add up, a coarser group or the whole platform is a second, tiny aggregation
(``merged_columns``), never a second pass over the base table. Columns a report does
not use are pruned from the aggregation by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.labels import PRICE_TIERS, QUALITY_LABELS, RATING_LABELS
from ..functions.numeric import exact, mean_of, percent, ratio, round_half_up
from ..schema import FIELDS, Fields
from ..sources.staging import write_stage

_LABEL_SUMS = {label: f"_label_{label.lower()}" for label in RATING_LABELS}
_TIER_SUMS = {tier: f"_tier_{i}" for i, tier in enumerate(PRICE_TIERS, 1)}


def sum_columns(fields: Fields = FIELDS) -> dict[str, Column]:
    rate, votes, cost = F.col(fields.rate), F.col(fields.votes), F.col(fields.cost)
    online, booking = F.col(fields.online), F.col(fields.booking)
    label, tier = F.col(fields.label), F.col(fields.tier)
    return {
        "_n": F.count(F.lit(1)),
        "_rated": F.count(rate),
        "_rate": F.sum(exact(rate)),
        "_cost_n": F.count(cost),
        "_cost": F.sum(cost.cast("bigint")),
        "_votes_n": F.count(votes),
        "_votes": F.sum(votes),
        "_online_n": F.count(online),
        "_online": F.sum(online.cast("bigint")),
        "_booking_n": F.count(booking),
        "_booking": F.sum(booking.cast("bigint")),
        "_both": F.count_if((online == 1) & (booking == 1)),
        "_online_only": F.count_if((online == 1) & (booking == 0)),
        "_table_only": F.count_if((online == 0) & (booking == 1)),
        "_neither": F.count_if((online == 0) & (booking == 0)),
        "_quality": F.count_if(label.isin(list(QUALITY_LABELS))),
        **{name: F.count_if(label == value) for value, name in _LABEL_SUMS.items()},
        **{name: F.count_if(tier == value) for value, name in _TIER_SUMS.items()},
    }


def group_sums(
    df: DataFrame, keys: Sequence[str] = (), *extra: Column, fields: Fields = FIELDS
) -> DataFrame:
    """One row of sums per key, with any ``extra`` aggregates alongside."""
    sums = [c.alias(name) for name, c in sum_columns(fields).items()]
    return df.groupBy(*keys).agg(*sums, *extra)


def merged_columns() -> list[Column]:
    return [F.sum(name).alias(name) for name in sum_columns()]


def with_platform(sums: DataFrame, *names: str, few: bool = False) -> DataFrame:
    """Add ``_all<name>``: each named sum over the whole frame.

    The sums are staged, so that the base table is read once, and the totals are scalar
    subqueries over them: no task has to hold all groups. ``few`` is for groups that a fixed
    list of labels bounds; a window over those few rows does.
    """
    if few:
        everything = W.partitionBy()
        return sums.withColumns({f"_all{name}": F.sum(name).over(everything) for name in names})
    sums = write_stage(sums, "sums")
    totals = sums.agg(*[F.sum(name).alias(name) for name in names])
    return sums.withColumns({f"_all{name}": totals.select(name).scalar() for name in names})


# Derived metrics: Column expressions over the sums above. ``prefix`` selects
# another set of sums, such as the ``_all`` columns of with_platform.


def n_rows() -> Column:
    return F.col("_n")


def mean_rate(prefix: str = "") -> Column:
    return mean_of(F.col(f"{prefix}_rate"), F.col(f"{prefix}_rated"))


def mean_cost() -> Column:
    return ratio(F.col("_cost"), F.col("_cost_n"))


def mean_votes() -> Column:
    return ratio(F.col("_votes"), F.col("_votes_n"))


def online_share(prefix: str = "") -> Column:
    return ratio(F.col(f"{prefix}_online"), F.col(f"{prefix}_online_n"))


def booking_share() -> Column:
    return ratio(F.col("_booking"), F.col("_booking_n"))


def avg_rating() -> Column:
    return round_half_up(mean_rate(), 2)


def avg_cost() -> Column:
    return round_half_up(mean_cost(), 0)


def avg_votes() -> Column:
    return round_half_up(mean_votes(), 0)


def share(part: str, whole: str = "_n", digits: int = 1) -> Column:
    return percent(F.col(part), F.col(whole), digits)


def quality_score() -> Column:
    """Good or Excellent among rated rows; null when nothing is rated."""
    return share("_quality", "_rated")


def unrated() -> Column:
    return F.col("_n") - F.col("_rated")


def unrated_pct() -> Column:
    return percent(unrated(), F.col("_n"))


def label_count(label: str) -> Column:
    return F.col(_LABEL_SUMS[label])


def label_pct(label: str) -> Column:
    """Share of all rows, unrated included."""
    return share(_LABEL_SUMS[label])


def tier_count(tier: str) -> Column:
    return F.col(_TIER_SUMS[tier])


def tier_pct(tier: str) -> Column:
    return share(_TIER_SUMS[tier])


def online_pct() -> Column:
    return round_half_up(online_share() * 100, 1)


def booking_pct() -> Column:
    return round_half_up(booking_share() * 100, 1)


def value_score() -> Column:
    return scores.value_score(mean_rate(), mean_cost())


def digital_score() -> Column:
    return scores.digital_score(online_share(), booking_share())


def performance_index() -> Column:
    return scores.performance_index(mean_rate(), mean_votes())
