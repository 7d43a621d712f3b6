"""Chat formatting by perspective rotation, in built-in operations.

Every participant of a dialogue gets a rendering of it in which that participant is the
assistant and all others are named users. A rendering stays in segments, one row per turn, with
the place of each segment in the whole text, so that a dialogue of any length is spread over
tasks; ``texts`` puts dialogues of ordinary length together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirstats.llm.scratch import written

#: Roles that speak to all sides and are nobody's perspective.
NARRATORS = ("system",)
UNKNOWN = "unknown"
END = "<|end|>\n"


def _header(role: Column, perspective: Column, narrators: tuple[str, ...]) -> Column:
    return (
        F.when(role.isin(*narrators), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .when(role == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def rotate(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """One row per turn and perspective of its dialogue: conv_id, perspective, position (from 1),
    role, segment (the rendered turn), start and end (of the segment in the rendered dialogue,
    in characters, end exclusive), and trained, true where the perspective speaks; mask_start
    and mask_end then enclose the text and its end mark, and are null elsewhere.

    turns has conv_id, turn, role and text; other columns are ignored. Turns are in order of
    turn, then role, then text, nulls first; repeated rows stay. A null text is empty. A null
    role is shown as a user named ``unknown`` and is no perspective; a dialogue without a
    perspective has no rows. Rows with a null conv_id are one dialogue.
    """
    rows = turns.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    sides = (
        rows.where(F.col("role").isNotNull() & ~F.col("role").isin(*narrators))
        .select(F.col("conv_id").alias("side_id"), F.col("role").alias("perspective"))
        .distinct()
    )
    role = F.coalesce("role", F.lit(UNKNOWN))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    header = F.when(F.col("role").isNull(), F.lit(f"<|user name={UNKNOWN}|>\n")).otherwise(
        _header(F.col("role"), F.col("perspective"), narrators)
    )
    seen = rows.join(sides, F.col("conv_id").eqNullSafe(F.col("side_id"))).select(
        "conv_id", "perspective", "turn", role.alias("role"), "row_id", "text",
        own.alias("trained"), header.alias("header"),
        F.concat(header, "text", F.lit(END)).alias("segment"),
    )
    # ranges cut long dialogues; a running sum inside of a range starts from those before it
    order = ["turn", "role", "text", "row_id"]
    ranged = written(
        seen.repartitionByRange("conv_id", "perspective", *order).withColumn(
            "part", F.spark_partition_id()
        ),
        "ranged",
    ).withColumn("size", F.length("segment").cast("long"))
    dialogue = ["conv_id", "perspective"]
    before = Window.partitionBy(*dialogue).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part", *dialogue)
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .select(
            F.col("part").alias("p"),
            F.col("conv_id").alias("c"),
            F.col("perspective").alias("s"),
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("chars_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"),
        )
    )
    inside = Window.partitionBy("part", *dialogue).orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.select(
        "*", F.sum("size").over(run).alias("chars"), F.row_number().over(inside).alias("n")
    ).join(
        offsets,
        (F.col("part") == F.col("p"))
        & F.col("conv_id").eqNullSafe(F.col("c"))
        & (F.col("perspective") == F.col("s")),
    )
    end = F.col("chars_before") + F.col("chars")
    start = end - F.col("size")
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("turns_before") + F.col("n")).alias("position"),
        "role",
        "segment",
        start.alias("start"),
        end.alias("end"),
        "trained",
        F.when(F.col("trained"), start + F.length("header")).alias("mask_start"),
        F.when(F.col("trained"), end).alias("mask_end"),
    )


def texts(segments: DataFrame) -> DataFrame:
    """Rendered dialogues (conv_id, perspective, text, masks) from the rows of ``rotate``. A
    dialogue becomes one row, so this is for dialogues that fit one."""
    mask = F.when(F.col("trained"), F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end")))
    return (
        segments.groupBy("conv_id", "perspective")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", "segment"))).alias("parts"),
            F.array_sort(F.collect_list(mask)).alias("masks"),
        )
        .select(
            "conv_id",
            "perspective",
            F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"),
            "masks",
        )
    )


#: ``rotate`` over the table conversations.
ROTATE_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), r AS (
  SELECT t.conv_id, perspective, turn, coalesce(role, 'unknown') AS role, text,
         coalesce(role = perspective, false) AS trained,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
              WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' || chr(10) END AS header
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, header || text || '<|end|>' || chr(10) AS segment FROM r
), w AS (
  SELECT *, row_number() OVER o AS position,
         CAST(sum(length(segment)) OVER o AS BIGINT) AS "end"
  FROM s
  WINDOW o AS (PARTITION BY conv_id, perspective
               ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, role, segment, "end" - length(segment) AS start, "end",
       trained,
       CASE WHEN trained THEN "end" - length(segment) + length(header) END AS mask_start,
       CASE WHEN trained THEN "end" END AS mask_end
FROM w
"""
