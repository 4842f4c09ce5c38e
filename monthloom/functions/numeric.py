"""Arithmetic with defined results for zero, null and out-of-range values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b for positive b, else null."""
    return F.when(b > 0, a / b)


def pct_change(now: Column, before: Column, limit: float = 10.0) -> Column:
    """now / before - 1 within +-limit; from zero the limit with the sign of now, or null if both are zero."""
    moved = clip(now / before - 1, -limit, limit)
    return F.when(now.isNull() | before.isNull(), None).when(
        before == 0, F.when(now != 0, F.signum(now) * limit)
    ).otherwise(moved)


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def per_period_hazard(cumulative: Column, periods: int) -> Column:
    """The constant hazard that accumulates to ``cumulative`` over so many periods."""
    return 1 - F.pow(1 - cumulative, F.lit(1.0 / periods))
