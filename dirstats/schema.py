"""Explicit schemas, one per grain. Nothing in this package infers a schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

RAW = _struct(
    **{
        "url": _S,
        "address": _S,
        "name": _S,
        "online_order": _S,
        "book_table": _S,
        "rate": _S,
        "votes": _L,
        "phone": _S,
        "location": _S,
        "rest_type": _S,
        "dish_liked": _S,
        "cuisines": _S,
        "approx_cost(for two people)": _S,
        "reviews_list": _S,
        "menu_item": _S,
        "listed_in(type)": _S,
        "listed_in(city)": _S,
    }
)

CLEAN = _struct(
    name=_S,
    online_order=_I,
    book_table=_I,
    rate=_D,
    votes=_L,
    location=_S,
    rest_type=_S,
    dish_liked=_S,
    cuisines=_S,
    approx_cost=_I,
    listed_type=_S,
    listed_city=_S,
)

FEATURES = _struct(price_category=_S, rating_label=_S, primary_cuisine=_S, cuisine_count=_I)

LISTING = T.StructType(CLEAN.fields + FEATURES.fields)

ENTITY = T.StructType([f for f in LISTING.fields if f.name != "listed_type"])

COORD = _struct(location=_S, latitude=_D, longitude=_D)

ENTITY_KEYS = ("name", "location")
CRITICAL = ("approx_cost", "rest_type", "cuisines", "location")
DROPPED = ("url", "address", "phone", "reviews_list", "menu_item")
RENAMED = {
    "approx_cost(for two people)": "approx_cost",
    "listed_in(type)": "listed_type",
    "listed_in(city)": "listed_city",
}


@dataclass(frozen=True)
class Fields:
    """Names of the measured columns, for tables that call them something else."""

    rate: str = "rate"
    votes: str = "votes"
    cost: str = "approx_cost"
    online: str = "online_order"
    booking: str = "book_table"
    label: str = "rating_label"
    tier: str = "price_category"


FIELDS = Fields()
