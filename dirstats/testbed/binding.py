"""The driver's tables seen as a raw listing export.

One listing per line item; the entity is (part, nation). Expressions and sizes
follow the project's fixture notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.cleaning import clean_parsed, parse_listings, with_features
from ..operators.entities import entities_from_parsed
from ..operators.joins import literal_frame
from ..sources.readers import read_table
from ..sources.staging import staged_once

# Columns that say which raw row came first.
INGEST_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey")


def raw_listings(spark: SparkSession, sf_dir: str, *, in_order: bool = False) -> DataFrame:
    """RAW columns plus INGEST_ORDER.

    Each join has a plain table on its right, whose size the planner knows from
    its files: small ones are broadcast, large ones shuffled. The largest comes first,
    while the rows are narrow; ``in_order`` sorts them by INGEST_ORDER before the texts are made.
    """
    lineitem, part, supplier, nation = (
        read_table(spark, f"{sf_dir}/{t}.parquet")
        for t in ("lineitem", "part", "supplier", "nation")
    )
    rows = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    if in_order:
        rows = rows.orderBy(*INGEST_ORDER)

    nation_key, line = F.col("n_nationkey"), F.col("l_linenumber")
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    tenths = F.least(
        F.lit(49),
        F.lit(14)
        + F.round(F.col("l_discount") * 100).cast("int") * 2
        + F.round(F.col("l_tax") * 100).cast("int")
        + nation_key % 4 * 2
        + brand % 4 * 2
        + F.when(price > 40050, 3).otherwise(0),
    )
    even = line % 2 == 0
    rating = F.concat(
        F.floor(tenths / 10).cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
        F.when(even, F.lit("/5")).otherwise(F.lit(" /5")),
    )
    unrated = F.when(even, F.lit("NEW")).otherwise(F.lit("-"))
    cost = F.floor(price / 50)
    thousands, rest = F.floor(cost / 1000).cast("string"), (cost % 1000).cast("string")
    quantity = F.col("l_quantity").cast("bigint")
    offline = ((flag == "R") & (nation_key % 3 != 0)) | ((flag == "A") & (nation_key % 4 == 0))
    columns = {
        "url": F.concat(F.lit("/listing/"), F.col("l_orderkey"), F.lit("/"), line),
        "address": F.concat_ws(", ", "s_name", "n_name"),
        "name": F.concat(F.lit(" "), F.col("p_name"), F.lit(" #"), F.col("p_partkey")),
        "online_order": F.when(offline, F.lit("No")).otherwise(F.lit("Yes")),
        "book_table": F.when(
            (F.col("l_linestatus") == "F") & (price > 50000), F.lit("Yes")
        ).otherwise(F.lit("No")),
        "rate": F.when((flag == "N") & (F.col("l_linestatus") == "O"), unrated).otherwise(rating),
        "votes": F.floor(quantity * quantity * quantity / 8),
        "phone": F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")),
        "location": F.col("n_name"),
        "rest_type": F.when(F.col("l_partkey") % 97 != 0, F.col("p_type")),
        "dish_liked": F.when(~even, F.col("p_name")),
        "cuisines": F.concat_ws(", ", "p_brand", "p_type"),
        "approx_cost(for two people)": F.when(
            cost >= 1000, F.concat(thousands, F.lit(","), F.lpad(rest, 3, "0"))
        ).otherwise(cost.cast("string")),
        "reviews_list": F.lit("[]"),
        "menu_item": F.lit("[]"),
        "listed_in(type)": flag,
        "listed_in(city)": F.col("n_regionkey").cast("string"),
    }
    return rows.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in S.RAW.fields], *INGEST_ORDER
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows, written once per application; raw text is not read again after that."""
    return staged_once(
        spark,
        f"parsed:{sf_dir}",
        "parsed",
        lambda: parse_listings(raw_listings(spark, sf_dir)),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned listings with features, written once per application and reused."""
    return staged_once(
        spark,
        f"listings:{sf_dir}",
        "listings",
        lambda: with_features(clean_parsed(parsed(spark, sf_dir), INGEST_ORDER)),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table, written once per application and queried many times."""
    return staged_once(
        spark,
        f"entities:{sf_dir}",
        "entities",
        lambda: entities_from_parsed(parsed(spark, sf_dir), INGEST_ORDER),
    )


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved coordinates per nation; keys ending in 9 are unresolved."""
    key = F.col("n_nationkey")
    nation = read_table(spark, f"{sf_dir}/nation.parquet")
    return nation.filter(key % 10 != 9).select(
        F.col("n_name").alias("location"),
        (F.lit(12.70) + F.lit(0.03) * key).alias("latitude"),
        (F.lit(77.30) + F.lit(0.02) * key).alias("longitude"),
    )


def overrides(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, S.COORD.fieldNames(), [("NATION_9", 12.95, 77.55)])
