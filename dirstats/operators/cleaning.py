"""Raw export -> typed listings -> listings with features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import labels
from ..functions import text as X
from ..functions.numeric import percent
from .crowding import TASK_ROWS, grouped
from .joins import null_safe_join

NO_DISH = "Not Available"


def strip_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: X.strip(F.col(f"`{name}`")) for name in strings})


def prepare_text(
    raw: DataFrame,
    *,
    dropped: Sequence[str] = S.DROPPED,
    renamed: Mapping[str, str] = S.RENAMED,
    dish_default: str = NO_DISH,
) -> DataFrame:
    """Drop unused columns, rename, fill the dish text, trim. Values stay text."""
    named = raw.drop(*dropped).withColumnsRenamed(dict(renamed))
    return strip_strings(named.fillna({"dish_liked": dish_default}))


def number_texts(prepared: DataFrame) -> DataFrame:
    """Reduce rating (``3.9 /5``) and cost (``1,200``) to bare number texts."""
    return prepared.withColumns(
        {
            "rate": X.rating_text(F.col("rate")),
            "approx_cost": X.cost_text(F.col("approx_cost")),
        }
    )


def type_listings(prepared: DataFrame) -> DataFrame:
    """Parse rating, cost and the two flags; cost fractions are cut off.

    Number texts are a projection of their own, so the parser, which reads its
    input twice, does not evaluate the text functions twice.
    """
    return number_texts(prepared).withColumns(
        {
            "rate": X.to_number(F.col("rate")),
            "approx_cost": X.to_number(F.col("approx_cost")).try_cast("int"),
            "online_order": X.parse_flag(F.col("online_order")),
            "book_table": X.parse_flag(F.col("book_table")),
        }
    )


def parse_listings(raw: DataFrame, **options: object) -> DataFrame:
    return type_listings(prepare_text(raw, **options))


def is_complete(critical: Sequence[str]) -> Column:
    complete = F.lit(True)
    for name in critical:
        complete = complete & F.col(name).isNotNull()
    return complete


def drop_incomplete(df: DataFrame, critical: Sequence[str] = S.CRITICAL) -> DataFrame:
    return df.dropna(how="any", subset=list(critical))


def first_flags(
    parsed: DataFrame,
    order_by: Sequence[str],
    *,
    keys: Sequence[str] = S.ENTITY_KEYS,
    flags: Sequence[str] = ("online_order", "book_table"),
) -> DataFrame:
    """Flags of the first row per key, in ``order_by`` order; unmapped flags become 0.

    The minimum of an (order, flags) struct is combined on the map side, so a
    key holding a third of the rows still sends one row per task. Rows with
    equal order values are told apart by the flags themselves.
    """
    first = parsed.groupBy(*keys).agg(F.min(F.struct(*order_by, *flags)).alias("_first"))
    return first.select(
        *keys, *[F.coalesce(F.col(f"_first.{f}"), F.lit(0)).alias(f) for f in flags]
    )


def clean_parsed(
    parsed: DataFrame,
    order_by: Sequence[str],
    *,
    keys: Sequence[str] = S.ENTITY_KEYS,
    critical: Sequence[str] = S.CRITICAL,
    keep_order: bool = False,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Complete, distinct listings with one pair of flags per entity.

    ``parsed`` is read several times, to find crowded entities, for the rows and for the
    flags of each entity's first row, so stage it when it comes from a large text export.
    ``order_by`` names the columns that say which raw row came first. Distinct runs over all
    columns, first-derived flags included, and only then are the flags replaced.
    With ``keep_order`` the smallest order values of each distinct row survive
    as ``_order``.

    Entities that fit a task of about ``task_rows`` rows are cleaned there, after one shuffle
    by their key; the flags of crowded ones come by a join, whose hot partitions AQE splits.
    """
    flags = ("online_order", "book_table")
    columns = S.CLEAN.fieldNames()
    shown = [*columns, "_order"] if keep_order else columns
    needed = list(dict.fromkeys([*columns, *order_by]))
    keyed = parsed.dropna(subset=[k for k in keys if k in critical]).select(*needed)

    def distinct(rows: DataFrame, *more: str) -> DataFrame:
        complete = drop_incomplete(rows, critical)
        if not keep_order:
            return complete.select(*columns, *more).distinct()
        first = F.min(F.struct(*order_by)).alias("_order")
        return complete.groupBy(*columns, *more).agg(first)

    def gathered(rows: DataFrame) -> DataFrame:
        first = F.min(F.struct(*order_by, *flags)).over(W.partitionBy(*keys))
        marked = rows.withColumn("_first", first).withColumns(
            {f"_first_{f}": F.coalesce(F.col(f"_first.{f}"), F.lit(0)) for f in flags}
        )
        unique = distinct(marked, *[f"_first_{f}" for f in flags])
        return unique.withColumns({f: F.col(f"_first_{f}") for f in flags}).select(*shown)

    def joined(rows: DataFrame) -> DataFrame:
        first = first_flags(rows, order_by, keys=keys)
        found = null_safe_join(distinct(rows).drop(*flags), first, keys)
        return found.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags}).select(*shown)

    return grouped(keyed, keys, gathered, joined, task_rows=task_rows)


def clean_listings(raw: DataFrame, order_by: Sequence[str], **options: object) -> DataFrame:
    """:func:`clean_parsed` straight from the raw export, without staging."""
    return clean_parsed(parse_listings(raw), order_by, **options)


def with_features(
    df: DataFrame, *, edges: Sequence[float | None] = labels.PRICE_EDGES
) -> DataFrame:
    """Add price tier, rating label, primary cuisine and cuisine count."""
    return df.withColumns(
        {
            "price_category": labels.bin_column(
                F.col("approx_cost"), edges, labels.PRICE_TIERS
            ),
            "rating_label": labels.rating_label(F.col("rate")),
            "primary_cuisine": X.first_item(F.col("cuisines")),
            "cuisine_count": X.item_count(F.col("cuisines")),
        }
    )


def null_drop_report(parsed: DataFrame, critical: Sequence[str] = S.CRITICAL) -> DataFrame:
    """Rows before and after dropping incomplete rows, and the share dropped."""
    total = F.count(F.lit(1))
    kept = F.count_if(is_complete(critical))
    return parsed.agg(
        total.alias("rows_before"),
        (total - kept).alias("rows_dropped"),
        percent(total - kept, total, 2).alias("pct_dropped"),
        kept.alias("rows_after"),
    )


def duplicate_report(
    df: DataFrame, columns: Sequence[str] | None = None, *, by_digest: bool = False
) -> DataFrame:
    """Rows, rows beyond the first of each identical group, and their share.

    Nulls compare equal. ``columns`` narrows the comparison to a key. For wide
    rows ``by_digest`` shuffles the SHA-256 of each row instead of the row.
    """
    compared = [F.col(f"`{c}`") for c in columns or df.columns]
    if by_digest:
        compared = [X.row_digest(compared).alias("_digest")]
    groups = df.groupBy(*compared).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    unique = F.count(F.lit(1))
    return groups.agg(
        rows.alias("total_rows"),
        (rows - unique).alias("duplicate_rows"),
        percent(rows - unique, rows, 2).alias("pct_of_total"),
        unique.alias("rows_after"),
    )


def reject_report(raw: DataFrame) -> DataFrame:
    """Texts that are present but could not be parsed, per parsed column."""
    texts = number_texts(prepare_text(raw))
    parsers = {
        "rate": X.to_number,
        "approx_cost": lambda text: X.to_number(text).try_cast("int"),
        "online_order": X.parse_flag,
        "book_table": X.parse_flag,
    }
    counts = texts.agg(
        *[
            F.count_if(F.col(name).isNotNull() & parse(F.col(name)).isNull()).alias(name)
            for name, parse in parsers.items()
        ]
    )
    return counts.unpivot([], list(parsers), "column_name", "rejected")
