"""Lenient number parsing for incoming requests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.functions.text import trim_white


def lenient_number(text: Column) -> Column:
    """Number of a request field: blank reads as 0, a missing field or other text as null."""
    t = trim_white(text)
    plain = F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    hexa = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double"))
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(plain, hexa))


def is_finite(number: Column) -> Column:
    """True for a present number that is neither NaN nor infinite."""
    return F.coalesce(~F.isnan(number) & (F.abs(number) != float("inf")), F.lit(False))


def is_whole(number: Column) -> Column:
    """True for a finite number without fraction."""
    return F.coalesce(is_finite(number) & (number == F.floor(number).cast("double")), F.lit(False))
