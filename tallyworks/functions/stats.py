"""Two-proportion test as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import rounded

# Rational approximation 7.1.26 of erf in Abramowitz and Stegun,
# Handbook of Mathematical Functions (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-(x * x))


def two_prop_z(x1: Column, n1: Column, x2: Column, n2: Column) -> dict[str, Column]:
    """Difference in points (2 dp), pooled z (2 dp) and two-sided p (4 dp); null when undefined."""
    x1, n1, x2, n2 = (c.cast("double") for c in (x1, n1, x2, n2))
    share1, share2 = F.try_divide(x1, n1), F.try_divide(x2, n2)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.try_divide(share1 - share2, error)
    return {
        "diff_points": rounded((share1 - share2) * 100, 2),
        "z": rounded(z, 2),
        "p": rounded(erfc(F.abs(z) / F.sqrt(F.lit(2.0))), 4),
    }
