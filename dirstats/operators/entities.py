"""Listing grain -> entity grain, and reports on the duplication between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.numeric import exact, exact_mean, ratio, round_half_up
from .cleaning import is_complete, with_features
from .crowding import TASK_ROWS, grouped

STRATEGIES = ("max_votes", "mean")


def dedup_entities(
    listings: DataFrame,
    *,
    strategy: str = "max_votes",
    keys: Sequence[str] = S.ENTITY_KEYS,
    votes: str = "votes",
    dropped: Sequence[str] = ("listed_type",),
    order: str | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per key.

    ``max_votes`` keeps the listing with the most votes. ``mean`` averages
    numeric columns and takes the first non-null of the others in the order of the
    column ``order``, which itself is left out.

    ``max_votes`` reads ``listings`` twice, the keys alone to find crowded ones (``crowding``).
    """
    if strategy == "max_votes":
        return _highest_votes(listings, keys, votes, dropped, task_rows)
    if strategy == "mean":
        if order is None:
            raise ValueError("strategy 'mean' needs order, the column that says what came first")
        return _mean_row(listings, keys, dropped, order)
    raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")


def _highest_votes(
    listings: DataFrame,
    keys: Sequence[str],
    votes: str,
    dropped: Sequence[str],
    task_rows: int,
) -> DataFrame:
    """The greatest (votes, every other column) struct per key.

    The maximum of a crowded key is combined on the map side, so it never gathers its
    rows in one task, and comparing whole rows makes the survivor of a tie on votes
    the same on every run. Null keys form a group of their own.
    """
    kept = [c for c in listings.columns if c not in (*keys, *dropped)]
    ranked = [votes, *[c for c in kept if c != votes]]

    def survivors(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("_best"))

    best = grouped(listings.drop(*dropped), keys, survivors, task_rows=task_rows)
    columns = [c for c in listings.columns if c not in dropped]
    return best.select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in columns]
    )


def _mean_row(
    listings: DataFrame, keys: Sequence[str], dropped: Sequence[str], order: str
) -> DataFrame:
    """Numeric means and first texts per key; rows with a null key are left out."""
    result = {}
    for field in listings.schema.fields:
        name, column = field.name, F.col(field.name)
        if name in keys or name in dropped or name == order:
            continue
        if isinstance(field.dataType, T.NumericType):
            whole = isinstance(field.dataType, T.IntegralType)
            result[name] = exact_mean(column, whole)
        else:
            first = F.min(F.when(column.isNotNull(), F.struct(F.col(order).alias("o"), column.alias("v"))))
            result[name] = first["v"]
    return (
        listings.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(*[value.alias(name) for name, value in result.items()])
    )


def entities_from_parsed(
    parsed: DataFrame,
    order_by: Sequence[str],
    *,
    keys: Sequence[str] = S.ENTITY_KEYS,
    critical: Sequence[str] = S.CRITICAL,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Entity table straight from parsed rows, in one shuffle.

    Equal to ``dedup_entities(with_features(clean_parsed(parsed, order_by)))``:
    the survivor of a key does not depend on exact copies, so the distinct step
    falls away, and the first row's flags come out of the same aggregation
    instead of a join. Both aggregates of a crowded key are combined on the map side;
    the keys are read once before to find those (``crowding``).
    """
    flags = ("online_order", "book_table")
    kept = [c for c in S.CLEAN.fieldNames() if c not in (*keys, *flags, "votes", "listed_type")]
    for key in keys:
        if key in critical:
            parsed = parsed.filter(F.col(key).isNotNull())
    survivor = F.when(is_complete(critical), F.struct("votes", *kept))
    needed = dict.fromkeys([*keys, "votes", *kept, *critical, *order_by, *flags])

    def survivors(rows: DataFrame) -> DataFrame:
        best, first = F.max(survivor), F.min(F.struct(*order_by, *flags))
        return rows.groupBy(*keys).agg(best.alias("_best"), first.alias("_first"))

    found = grouped(parsed.select(*needed), keys, survivors, task_rows=task_rows)
    clean = found.filter(F.col("_best").isNotNull()).select(
        *keys,
        *[F.col(f"_best.{c}").alias(c) for c in ("votes", *kept)],
        *[F.coalesce(F.col(f"_first.{f}"), F.lit(0)).alias(f) for f in flags],
    )
    return with_features(clean).select(*S.ENTITY.fieldNames())


def key_sizes(listings: DataFrame, keys: Sequence[str] = S.ENTITY_KEYS) -> DataFrame:
    """Listings per key, rows with a null key left out."""
    return (
        listings.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("listings"))
    )


def duplication_report(listings: DataFrame, keys: Sequence[str] = S.ENTITY_KEYS) -> DataFrame:
    """Total rows, entities, surplus rows and mean listings per entity."""
    sizes = listings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows, entities = F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))
    return sizes.agg(
        rows.alias("total_rows"),
        entities.alias("unique_entities"),
        (rows - entities).alias("duplicate_rows"),
        round_half_up(ratio(rows, entities), 2).alias("avg_listings_per_entity"),
    )


def size_distribution(listings: DataFrame, keys: Sequence[str] = S.ENTITY_KEYS) -> DataFrame:
    """How many entities have 1, 2, 3 ... listings."""
    return (
        key_sizes(listings, keys)
        .groupBy("listings")
        .agg(F.count(F.lit(1)).alias("entities"))
        .orderBy("listings")
    )


def most_duplicated(
    listings: DataFrame,
    keys: Sequence[str] = S.ENTITY_KEYS,
    show: Sequence[str] = ("name", "location", "listed_type", "votes", "rate"),
) -> DataFrame:
    """All listings of the entity with the most of them, ties by key order."""
    top = key_sizes(listings, keys).orderBy(F.desc("listings"), *keys).limit(1).drop("listings")
    return listings.join(F.broadcast(top), list(keys), "left_semi").select(*show)


def consistency_report(
    listings: DataFrame,
    columns: Sequence[str] = ("votes", "rate"),
    keys: Sequence[str] = S.ENTITY_KEYS,
) -> DataFrame:
    """Per column: entities whose listings disagree, and the widest spread."""
    exact_values = {c: exact(F.col(c)) for c in columns}
    spreads = (
        listings.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(*[(F.max(v) - F.min(v)).alias(c) for c, v in exact_values.items()])
    )
    summary = spreads.agg(
        *[
            F.struct(
                F.count_if(F.col(c) > 0).alias("inconsistent_entities"),
                round_half_up(F.max(c), 2).alias("max_spread"),
            ).alias(c)
            for c in columns
        ]
    )
    return summary.unpivot([], list(columns), "column_name", "_s").select(
        "column_name", "_s.inconsistent_entities", "_s.max_spread"
    )


def named_rows(df: DataFrame, names: Sequence[str], show: Sequence[str]) -> DataFrame:
    """Rows of a few named entities."""
    return df.filter(F.col("name").isin(list(names))).select(*show)


def spot_check(
    entities: DataFrame, expected: DataFrame, keys: Sequence[str] = S.ENTITY_KEYS
) -> DataFrame:
    """Expected rows next to what the entity table holds, with a verdict per row."""
    measures = [c for c in expected.columns if c not in keys]
    found = entities.select(
        *keys, F.lit(True).alias("_found"), *[F.col(c).alias(f"actual_{c}") for c in measures]
    )
    # only the few expected keys are looked up, however large the table is
    wanted = found.join(expected.select(*keys).distinct(), list(keys), "left_semi")
    joined = expected.join(wanted, list(keys), "left")
    same = F.coalesce(F.col("_found"), F.lit(False))
    for c in measures:
        same = same & F.col(c).eqNullSafe(F.col(f"actual_{c}"))
    return joined.withColumn("matches", same).drop("_found")


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """Row counts and summed measures per key on both sides, and their difference.

    Both sides go through one aggregation by key, so there is no join, a null
    key meets a null key, and a hot key is combined on the map side. A key that
    one side lacks has 0 rows there.
    """
    a, b = names
    tagged = left.select(*keys, *measures, F.lit(a).alias("_side")).unionByName(
        right.select(*keys, *measures, F.lit(b).alias("_side"))
    )

    def on(side: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == side, value)), F.lit(0))

    values = {"rows": F.lit(1), **{m: F.col(m) for m in measures}}
    totals = tagged.groupBy(*keys).agg(
        *[on(side, value).alias(f"{side}_{m}") for side in names for m, value in values.items()]
    )
    return totals.withColumns(
        {f"{m}_difference": F.col(f"{a}_{m}") - F.col(f"{b}_{m}") for m in values}
    )
