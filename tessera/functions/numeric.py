"""Numeric scalar helpers (MTH-F2, PRJ-06).

Rounding follows numpy / pandas: scale, round to an integer, unscale.  ``F.bround`` works
on the decimal text of the double instead, which disagrees with pandas on values that sit
on a half-way point after scaling (averages of cent prices hit them often).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, n: int = 0) -> Column:
    """pandas ``Series.round(n)``: half-even on the scaled double.

    The value is first snapped to n+3 decimals, so a result that is a half-way point up to
    float noise (an average of cent prices over 200 rows) rounds the same whichever order
    the engine summed in."""
    fine = F.rint(_c(c).cast("double") * float(10 ** (n + 3)))
    return F.rint(fine / 1000.0) / float(10 ** n)


def round_half_up(c, n: int = 0) -> Column:
    """SQL ``round(x, n)`` on doubles: half away from zero on the scaled double."""
    s = float(10 ** n)
    return F.round(_c(c).cast("double") * s, 0) / s


def is_finite(c) -> Column:
    """Not null, not NaN, not +-infinity."""
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(c) -> Column:
    """NaN -> null (Spark treats NaN = NaN as true and sorts it last)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)
