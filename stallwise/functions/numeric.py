"""Money, ratios and NULL-strict extremes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amounts are counted in ticks: whole ten-thousandths, held as bigint.  Products of
# a two-digit amount and a two-digit rate are whole too, so sums are exact, do not
# depend on the order of rows, and stay in generated code at the cost of a long.
TICKS = 10_000
_LOW_BITS = 20


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def cents(amount: Column | str) -> Column:
    """A two-digit amount stored as double, as a whole number of cents."""
    return F.rint(_column(amount) * 100).cast("long")


def percent(fraction: Column | str) -> Column:
    """A two-digit fraction stored as double, as a whole number of percent."""
    return F.rint(_column(fraction) * 100).cast("long")


def money(amount: Column | str) -> Column:
    """A two-digit amount stored as double, in ticks."""
    return cents(amount) * 100


def amount(ticks: Column, unit: int = TICKS) -> Column:
    """Ticks (or smaller parts, ``unit`` to one) as a double amount."""
    return ticks.cast("double") / F.lit(float(unit))


def exact_sum(ticks: Column) -> Column:
    """Sum of any number of bigints as decimal, without overflow.

    High and low bits are summed apart, both as bigint: the low part grows by
    less than 2^20 per row, so it holds for more than 10^12 rows of a group.
    """
    high = F.sum(F.shiftright(ticks, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(ticks.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    return high * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + low


def total(ticks: Column, unit: int = TICKS) -> Column:
    """Exact sum as a double amount."""
    return amount(exact_sum(ticks), unit)


def mean(ticks: Column) -> Column:
    """Exact sum over count of the non-NULL values; NULL when there are none."""
    return safe_ratio(total(ticks), F.count(ticks))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL when the denominator is zero or either side is NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _null_if_any_null(value: Column, inputs: tuple[Column, ...]) -> Column:
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in inputs])
    return F.when(~missing, value)


def strict_greatest(*inputs: Column) -> Column:
    """GREATEST that is NULL as soon as one argument is NULL."""
    return _null_if_any_null(F.greatest(*inputs), inputs)


def strict_least(*inputs: Column) -> Column:
    """LEAST that is NULL as soon as one argument is NULL."""
    return _null_if_any_null(F.least(*inputs), inputs)


def round_to_scale(amount: Column, scale: Column, scales: range = range(-6, 11)) -> Column:
    """Round half away from zero to a number of digits that varies by row; NULL without one.

    Spark rounds to a constant scale only, so one branch per scale is chosen by
    the row.  A scale outside ``scales`` is an error, never an unrounded amount.
    """
    outside = F.raise_error(F.concat(F.lit("cannot round to scale "), scale.cast("string"))).cast("double")
    rounded = F.when(scale.isNotNull() & amount.isNotNull(), outside)
    for digits in scales:
        branch = F.round(amount, digits).cast("double")
        rounded = F.when(scale == digits, branch).otherwise(rounded)
    return rounded
