"""Exact sums, rounding and small numeric rules.

Sums of doubles depend on the order in which partitions arrive. Numbers are
therefore summed as decimals, which gives the same bits whatever the
partitioning and after any task retry; only digits behind the twelfth are
rounded before the sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,12)"


def flag(condition: Column) -> Column:
    """1, 0 or null for a boolean."""
    return condition.cast("int")


def count_where(condition: Column) -> Column:
    """Number of rows for which the condition is true."""
    return F.count(F.when(condition, 1))


def exact_sum(value: Column) -> Column:
    """Order-independent sum of the decimal readings, 12 digits behind the point.

    A number that does not fit (beyond 10^26, or not a number) and a sum that does not fit are errors.
    """
    decimal = value.cast(WIDE)
    lost = F.when(value.isNotNull(), F.raise_error(F.lit("a number has no decimal reading")).cast(WIDE))
    return F.sum(F.coalesce(decimal, lost))


def exact_mean(value: Column) -> Column:
    """Order-independent mean of the non-null values, null when there are none."""
    return F.try_divide(exact_sum(value).cast("double"), F.count(value).cast("double"))


def rate(condition: Column) -> Column:
    """Share of true among the non-null values of a boolean."""
    return F.try_divide(F.sum(flag(condition)).cast("double"), F.count(condition).cast("double"))


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding of the decimal reading of a number."""
    return F.round(value.cast(WIDE), places).cast("double")


def rounded_even(value: Column, places: int) -> Column:
    """Half-even rounding of the scaled double, as array libraries round."""
    scale = float(10**places)
    return F.rint(value.cast("double") * scale) / scale


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, zero when the bottom is zero or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def outside_limits(value: Column, lower: Column, upper: Column) -> Column:
    """True beyond a limit; a null limit is not checked."""
    return F.coalesce(value > upper, F.lit(False)) | F.coalesce(value < lower, F.lit(False))


def pack_bits(flags: list[Column]) -> Column:
    """First flag in bit 0, second in bit 1 and so on; null counts as unset."""
    packed = F.lit(0)
    for position, condition in enumerate(flags):
        packed = packed.bitwiseOR(F.shiftleft(F.coalesce(flag(condition), F.lit(0)), position))
    return packed


def first_match(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first true condition, else the default."""
    (condition, value), *rest = cases
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def bucketed(value: Column, cuts: list[tuple[float, str]], last: str) -> tuple[Column, Column]:
    """(ordinal, label) of the first cut that the value does not exceed."""
    order = first_match([(value <= cut, i) for i, (cut, _) in enumerate(cuts)], len(cuts))
    label = first_match([(value <= cut, text) for cut, text in cuts], last)
    return order, label
