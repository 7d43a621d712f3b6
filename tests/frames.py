"""Small hand-made frames for unit tests."""

from __future__ import annotations

from pyspark.sql import types as T

from dirstats import schema as S

RAW_WITH_ORDINAL = T.StructType([*S.RAW.fields, T.StructField("ordinal", T.LongType())])

RAW_DEFAULTS = {
    "url": "u",
    "address": "a",
    "name": "Cafe",
    "online_order": "Yes",
    "book_table": "No",
    "rate": "3.9/5",
    "votes": 10,
    "phone": None,
    "location": "North",
    "rest_type": "Cafe",
    "dish_liked": None,
    "cuisines": "Italian, Pizza",
    "approx_cost(for two people)": "500",
    "reviews_list": "[]",
    "menu_item": "[]",
    "listed_in(type)": "Delivery",
    "listed_in(city)": "City",
}

ENTITY_DEFAULTS = {
    "name": "Cafe",
    "online_order": 1,
    "book_table": 0,
    "rate": 3.9,
    "votes": 10,
    "location": "North",
    "rest_type": "Cafe",
    "dish_liked": "Not Available",
    "cuisines": "Italian, Pizza",
    "approx_cost": 500,
    "listed_city": "City",
    "price_category": "Mid-range",
    "rating_label": "Good",
    "primary_cuisine": "Italian",
    "cuisine_count": 2,
}


def raw(spark, *rows):
    """RAW rows plus an ``ordinal`` that follows the argument order."""
    names = S.RAW.fieldNames()
    data = [
        tuple({**RAW_DEFAULTS, **row}[n] for n in names) + (i,) for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, RAW_WITH_ORDINAL)


def entities(spark, *rows):
    """ENTITY rows; labels are taken from the row as given, not derived."""
    names = S.ENTITY.fieldNames()
    return spark.createDataFrame(
        [tuple({**ENTITY_DEFAULTS, **row}[n] for n in names) for row in rows], S.ENTITY
    )


def listings(spark, *rows):
    names = S.LISTING.fieldNames()
    defaults = {**ENTITY_DEFAULTS, "listed_type": "Delivery"}
    return spark.createDataFrame(
        [tuple({**defaults, **row}[n] for n in names) for row in rows], S.LISTING
    )


def column(df, name):
    return [r[name] for r in df.collect()]
