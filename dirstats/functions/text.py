"""Parsing of the raw text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts a rating column uses for "no rating yet".
NOT_RATED = ("NEW", "-")

# Flag texts.
YES_NO = {"Yes": 1, "No": 0}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def null_if_in(value: Column, tokens: Sequence[str]) -> Column:
    return F.when(~value.isin(list(tokens)), value)


def to_number(value: Column) -> Column:
    """Double, or null for text that is not a plain decimal number."""
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def rating_text(value: Column, missing: Sequence[str] = NOT_RATED) -> Column:
    """Numerator text of ``3.9/5`` or ``3.9 /5``; null for missing markers."""
    present = F.replace(null_if_in(value, missing), F.lit(" "), F.lit(""))
    return F.split_part(present, F.lit("/"), F.lit(1))


def cost_text(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(""))


def map_values(value: Column, mapping: Mapping[str, int | str]) -> Column:
    """Dictionary lookup; anything outside the mapping becomes null."""
    items = iter(mapping.items())
    key, mapped = next(items)
    ladder = F.when(value == key, F.lit(mapped))
    for key, mapped in items:
        ladder = ladder.when(value == key, F.lit(mapped))
    return ladder


def parse_flag(value: Column) -> Column:
    return map_values(value, YES_NO).cast("int")


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row. JSON leaves null fields out, so null and empty text differ;
    timestamps count to the microsecond."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.sha2(F.to_json(F.struct(*columns), options), 256)


def first_item(value: Column, delimiter: str = ",") -> Column:
    return strip(F.split_part(value, F.lit(delimiter), F.lit(1)))


def item_count(value: Column, delimiter: str = ",") -> Column:
    """Number of list entries; a trailing delimiter counts an empty entry."""
    removed = F.length(value) - F.length(F.replace(value, F.lit(delimiter), F.lit("")))
    return (removed / len(delimiter) + 1).cast("int")
