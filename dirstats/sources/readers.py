"""Readers. Every file read carries an explicit schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import null_if_in

# Texts a CSV export uses for a missing cell.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


#: What the note on a malformed record begins with.
FIELDS, VALUE = "fields", "value"
_RECORD = "_malformed_record"


def blank_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn missing-value texts in string columns into null."""
    return df.select(
        *[
            null_if_in(F.col(f"`{f.name}`"), tokens).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    multiline: bool = False,
    null_tokens: Sequence[str] = NULL_TOKENS,
    ordinal: str | None = None,
    malformed: str | None = None,
) -> DataFrame:
    """CSV with header, doubled-quote escapes and an optional byte-order mark.

    ``multiline`` is needed when quoted text holds line breaks; it makes a file
    one task, so large exports should be many files. ``ordinal`` adds a column
    that follows the rows: a number for a single file, and for several a struct of
    file path, block and place in it, so that the files come in order of their paths.

    A record that does not fit ends the job. With ``malformed`` it stays instead:
    that column says what is wrong with it (``FIELDS`` and the record, or ``VALUE``
    and the fields that are no value of their type) and is null in good records.
    """
    # Numbers are read as text first, so that a missing-value text in a numeric
    # column is a null and not a malformed record.
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    if malformed:
        text_schema = text_schema.add(_RECORD, T.StringType())
    rows = (
        spark.read.schema(text_schema)
        .option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE" if malformed else "FAILFAST")
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("enforceSchema", False)
        .csv(path)
    )
    extra = []
    if ordinal:
        place = F.monotonically_increasing_id()
        if len(rows.inputFiles()) > 1:
            place = F.struct("_metadata.file_path", "_metadata.file_block_start", place.alias("place"))
        extra = [place.alias(ordinal)]
    clean = {f.name: null_if_in(F.col(f"`{f.name}`"), null_tokens) for f in schema.fields}
    if not malformed:
        fields = [clean[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
        return rows.select(*fields, *extra)
    value = {f.name: clean[f.name].try_cast(f.dataType) for f in schema.fields}
    wrong = F.concat_ws(
        ", ",
        *[
            F.when(clean[n].isNotNull() & v.isNull(), F.concat(F.lit(f"{n}="), clean[n]))
            for n, v in value.items()
        ],
    )
    whole = F.col(_RECORD).isNull()
    said = F.when(~whole, F.concat(F.lit(f"{FIELDS}: "), _RECORD)).when(
        wrong != "", F.concat(F.lit(f"{VALUE}: "), wrong)
    )
    fields = [F.when(whole, v).alias(n) for n, v in value.items()]
    return rows.select(*fields, said.alias(malformed), *extra)


def malformed_report(rows: DataFrame, malformed: str) -> DataFrame:
    """One row: records read, and of them the good ones and the bad ones by what is wrong."""
    said = F.col(malformed)
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(said.isNull()).alias("good"),
        F.count_if(said.startswith(f"{FIELDS}:")).alias("wrong_fields"),
        F.count_if(said.startswith(f"{VALUE}:")).alias("wrong_values"),
    )


def read_raw(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """The 17-column raw export; review texts may contain line breaks."""
    return read_csv(spark, path, S.RAW, **{"multiline": True, **options})


def read_listings(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_csv(spark, path, S.LISTING, **options)


def read_entities(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_csv(spark, path, S.ENTITY, **options)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.COORD)


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A published result file: quoted values, bare NULL for missing."""
    return read_csv(spark, path, schema, null_tokens=("NULL", ""))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, the hand-off format between stages."""
    return spark.read.parquet(path)


def sql_over(spark: SparkSession, statement: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL text over named frames, e.g. ``{entities}`` in the statement."""
    return spark.sql(statement, **views)
