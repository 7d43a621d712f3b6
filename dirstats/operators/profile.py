"""Profiling: missingness, frequencies, shares, correlation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import correlation_strength
from ..functions.numeric import approx_median, exact_mean, percent, ratio, round_half_up
from ..sources.staging import write_stage
from .cumulative import exact_medians, value_counts_of
from .joins import literal_frame


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def missing_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Null count and percent per column, most missing first; one pass."""
    total = F.count(F.lit(1))
    row = df.agg(
        *[
            F.struct(
                F.count_if(_quoted(c).isNull()).alias("n"),
                percent(F.count_if(_quoted(c).isNull()), total, 2).alias("pct"),
            ).alias(c)
            for c in df.columns
        ]
    )
    long = row.unpivot([], [_quoted(c) for c in df.columns], "column_name", "_m").select(
        "column_name",
        F.col("_m.n").alias("missing_count"),
        F.col("_m.pct").alias("missing_pct"),
    )
    kept = long.filter(F.col("missing_count") > 0) if only_missing else long
    return kept.orderBy(F.desc("missing_count"), "column_name")


def value_counts(
    df: DataFrame, column: str, top: int | None = None, *, out: str = "row_count"
) -> DataFrame:
    """Frequency of each non-null value, most frequent first, ties by value."""
    counts = (
        df.filter(_quoted(column).isNotNull())
        .groupBy(_quoted(column).alias(column))
        .agg(F.count(F.lit(1)).alias(out))
        .orderBy(F.desc(out), _quoted(column))
    )
    return counts.limit(top) if top else counts


def _long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count per (column, non-null value) of several columns in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), _quoted(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    long = df.select(F.inline(cells)).filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("row_count"))


def frequencies(df: DataFrame, tops: dict[str, int | None]) -> DataFrame:
    """Top values of several columns in one long frame, ties by value.

    The table is read once: counts of all columns are written, and columns with a limit and
    those without are taken from there. So a column without a limit is never ordered in one task.
    The limit is a row number filter, which Spark also applies before the shuffle.
    """
    limited = {c: top for c, top in tops.items() if top}
    unlimited = [c for c, top in tops.items() if not top]
    counts = write_stage(_long_counts(df, list(tops)), "frequencies")
    parts = []
    if limited:
        by_count = W.partitionBy("column_name").orderBy(F.desc("row_count"), "value")
        limits = F.create_map(*[F.lit(x) for item in limited.items() for x in item])
        numbered = counts.filter(F.col("column_name").isin(list(limited))).withColumn(
            "_rn", F.row_number().over(by_count)
        )
        parts.append(
            numbered.filter(F.col("_rn") <= max(limited.values()))
            .filter(F.col("_rn") <= limits[F.col("column_name")])
            .drop("_rn")
        )
    if unlimited:
        parts.append(counts.filter(F.col("column_name").isin(unlimited)))
    return reduce(DataFrame.unionByName, parts)


def value_shares(
    df: DataFrame, column: str, digits: int = 1, *, nulls: bool = True
) -> DataFrame:
    """Count per value, with percent of all rows; the row of nulls is optional.

    The total is a scalar subquery over the counts, so no task has to hold all
    distinct values. As long as no filter is pushed under only one of them, both
    read the same shuffle and the rows are scanned once. So nulls are left out by
    a count of their own, which the total reads as well.
    """
    if nulls:
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
        total = counts.agg(F.sum("row_count")).scalar()
    else:
        counts = df.groupBy(column).agg(
            F.count(F.lit(1)).alias("row_count"), F.count(column).alias("_present")
        )
        total = counts.agg(F.sum(F.greatest("row_count", "_present"))).scalar()
        counts = counts.filter(F.col("_present") > 0).drop("_present")
    return counts.withColumn("pct_of_total", percent(F.col("row_count"), total, digits))


def value_range(df: DataFrame, column: str, *, approx: bool = False) -> DataFrame:
    """Low, high, mean and median of a whole-number column, one row.

    The median is found by position in staged (value, count) pairs, of which only
    the middle ones leave their task. ``approx`` reads it from a sketch instead.
    """
    value = F.col(column)
    if approx:
        return df.agg(
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            exact_mean(value).alias("mean"),
            approx_median(value).alias("median"),
        )
    counts = value_counts_of(df, column)
    ends = counts.agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        ratio(F.sum(value.cast("bigint") * F.col("_n")), F.sum("_n")).alias("mean"),
    )
    return ends.withColumn("median", exact_medians(counts, column).scalar())


def in_label_order(
    df: DataFrame, column: str, labels: Sequence[str], zero_filled: Sequence[str] = ()
) -> DataFrame:
    """One row per label in the given order, present in the data or not.

    ``zero_filled`` columns read 0 for an absent label, the others null. A null
    label matches none; made empty, it lets the join infer no filter that would
    be pushed under the aggregation of ``df``.
    """
    df = df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    order = literal_frame(
        df.sparkSession, [column, "_order"], [(label, i) for i, label in enumerate(labels)]
    )
    joined = order.join(df, column, "left").orderBy("_order").drop("_order")
    return joined.fillna(0, subset=list(zero_filled)) if zero_filled else joined


#: Type in which moments are summed: values to 10^13 with squares to 10^26.
_MOMENT = "decimal(36,10)"


def _pearson(a: str, b: str, complete: Sequence[str]) -> Column:
    """Correlation over rows where both are present; null if either is constant there.

    The built-in ``corr`` merges partial moments in the order in which they arrive, and
    divides by zero on a constant column under ANSI mode. Here a row's value, square and
    product are rounded to ``_MOMENT`` first and then summed exactly, so the result has
    the same bits however the rows are spread. Constancy is read from the minimum and
    maximum.
    """

    def present(name: str, other: str) -> Column:
        value = F.col(name).cast("double")
        return value if other in complete else F.when(F.col(other).isNotNull(), value)

    def moment(value: Column) -> Column:
        return F.sum(value.cast(_MOMENT)).cast("double")

    x, y = present(a, b), present(b, a)
    n = F.count(x * y).cast("double")
    sx, sy = moment(x), moment(y)
    spread = F.sqrt(n * moment(x * x) - sx * sx) * F.sqrt(n * moment(y * y) - sy * sy)
    vary = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(vary, F.try_divide(n * moment(x * y) - sx * sy, spread))


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], complete: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form, from one aggregation.

    ``complete`` names columns known to hold no null. Their partners need no
    masking, which lets pairs share their moments.
    """
    pairs = list(combinations(columns, 2))
    row = df.agg(
        *[round_half_up(_pearson(a, b, complete), digits).alias(f"{a}|{b}") for a, b in pairs],
        *[F.when(F.min(c) < F.max(c), F.lit(1.0)).alias(f"{c}|{c}") for c in columns],
    )
    mirrored = [(f"{a}|{b}", a, b) for a, b in pairs] + [(f"{a}|{b}", b, a) for a, b in pairs]
    cells = mirrored + [(f"{c}|{c}", c, c) for c in columns]
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), _quoted(name).alias("corr"))
            for name, a, b in cells
        ]
    )
    return row.select(F.inline(entries))


def target_correlations(matrix: DataFrame, target: str) -> DataFrame:
    """One target's correlations, strongest first, with direction and strength."""
    value = F.col("corr")
    return (
        matrix.filter((F.col("col_a") == target) & (F.col("col_b") != target))
        .select(
            F.col("col_b").alias("column_name"),
            "corr",
            F.when(value > 0, F.lit("positive"))
            .when(value.isNotNull(), F.lit("negative"))
            .alias("direction"),
            correlation_strength(value).alias("strength"),
        )
        .orderBy(F.abs(value).desc_nulls_last(), "column_name")
    )


def cleaned_profile(df: DataFrame) -> DataFrame:
    """Shape, remaining nulls, ranges and adoption of a cleaned table, one row."""
    remaining = sum(
        (F.count_if(_quoted(c).isNull()) for c in df.columns[1:]),
        F.count_if(_quoted(df.columns[0]).isNull()),
    )
    flags = {"online_order": "online_pct", "book_table": "booking_pct"}
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        remaining.alias("null_cells"),
        F.min("approx_cost").alias("min_cost"),
        F.max("approx_cost").alias("max_cost"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
        *[
            percent(F.sum(F.col(flag).cast("bigint")), F.count(flag)).alias(out)
            for flag, out in flags.items()
        ],
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column its place, type, and filled and missing cells, from one aggregation."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(_quoted(f.name)).alias(f"_{i}") for i, f in enumerate(fields)])
    cells = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"_{i}").alias("non_null"),
            (F.col("_n") - F.col(f"_{i}")).alias("nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return row.select(F.inline(F.array(*cells)))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
