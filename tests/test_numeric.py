"""Sums and means at the ends of their range."""

import pytest
from pyspark.sql import functions as F

from tallyworks.functions.numeric import exact_mean, exact_sum


def sums(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    return df.agg(exact_sum(F.col("v")).cast("double"), exact_mean(F.col("v"))).first()


@pytest.mark.parametrize(("values", "total"), [
    ([1e11, 1e11], 2e11), ([1e-9] * 5, 5e-9), ([-1.25, 0.25, None], -1.0), ([0.1234567894, 0.1234567894], 0.2469135788),
    ([123456789.12345678, -0.00000001], 123456789.12345677), ([1e20, 1.0, -1e20], 1.0), ([0.1] * 10, 1.0),
])
def test_sums_keep_all_digits(spark, values, total):
    n = sum(v is not None for v in values)
    assert tuple(sums(spark, values)) == (total, total / n)


def test_nothing_to_sum(spark):
    assert tuple(sums(spark, [None, None])) == (None, None)
    assert tuple(sums(spark, [])) == (None, None)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 1e30])
def test_numbers_without_a_decimal_reading_are_errors(spark, value):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|no decimal reading|cannot be represented"):
        sums(spark, [value, 1.0])
