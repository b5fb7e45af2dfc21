"""Column expressions that build labels and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latelane.functions.numbers import fixed_text


def route_pair(origin: Column, destination: Column) -> Column:
    """``A->B``; missing when either end is missing."""
    return F.concat(origin, F.lit("->"), destination)


def route_label(origin: Column, destination: Column) -> Column:
    """``A->B`` with a missing end printed as ``None``."""
    return F.concat(F.coalesce(origin, F.lit("None")), F.lit("->"), F.coalesce(destination, F.lit("None")))


def percent(c: Column) -> Column:
    """Share as percent with one decimal."""
    return F.concat(fixed_text(c * 100.0, 1), F.lit("%"))


def signed_percent(c: Column) -> Column:
    """Share as percent with one decimal and always a sign, also that of a negative zero."""
    return F.concat(fixed_text(c * 100.0, 1, signed=True), F.lit("%"))


def or_missing(c: Column) -> Column:
    """Text of a value, ``None`` where it is missing."""
    return F.coalesce(c.cast("string"), F.lit("None"))
