"""Column expressions on numbers, all evaluated inside Spark's generated code."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(c: Column) -> Column:
    """NaN and the two infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def at_least(c: Column, bound: float) -> Column:
    """``max(c, bound)`` that keeps a missing value missing."""
    return F.when(c < bound, F.lit(bound)).otherwise(c)


def at_most(c: Column, bound: float) -> Column:
    return F.when(c > bound, F.lit(bound)).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` held inside [low, high]; a missing value stays missing."""
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def mean_of(*columns: Column) -> Column:
    """Plain mean of a few columns (soft vote)."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / float(len(columns))


def mean_of_arrays(*arrays: Column) -> Column:
    """Element-wise mean of equally long arrays (vote of several classifiers)."""
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return F.transform(total, lambda x: x / float(len(arrays)))


def argmax_index(a: Column) -> Column:
    """Zero-based position of the largest element, the first one of a tie."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def value_per_kg(value: Column, weight: Column) -> Column:
    """Value over weight, a weight below one kilogram counting as one."""
    return value / at_least(weight, 1.0)


def half_unit(digits: int) -> tuple[float, bool]:
    """Half a unit of the last kept digit and whether its stored value is above the tie."""
    tie = Fraction(1, 2 * 10**digits)
    stored = float(tie)
    return stored, Fraction(stored) > tie


def fixed_text(c: Column, digits: int, grouped: bool = False, signed: bool = False) -> Column:
    """Text with a fixed count of decimals, rounding the stored binary value, ties to even.

    Number formatting rounds like that but for half a unit itself.
    """
    plus = "+" if signed else ""
    pattern = ("#,##0" if grouped else "0") + ("." + "0" * digits if digits else "")
    text = F.call_function("format_number", c, F.lit(f"+{pattern};-{pattern}" if signed else pattern))
    half, above = half_unit(digits)
    if not above:
        return text
    unit = "0." + "0" * (digits - 1) + "1"
    return F.when(c == half, plus + unit).when(c == -half, "-" + unit).otherwise(text)


def round_stored(c: Column, digits: int) -> Column:
    """Round the stored binary value, an exact tie going to the even digit.

    ``F.round`` and ``F.bround`` work on the shortest decimal text, so they move values
    such as 0.3335 (stored slightly below) the other way.  Away from a tie the nearest
    whole number of units is certain; near one the exact text decides.  A negative value
    that rounds to zero keeps its sign.
    """
    unit = 10.0**digits
    units = c * unit
    near_tie = F.abs(F.abs(units - F.rint(units)) - 0.5) < 1e-6
    return F.when(near_tie, fixed_text(c, digits).cast("double")).otherwise(F.rint(units) / unit)
