"""Numeric guards: a value that is not finite or out of range is unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onledger.params import CLOCK_SKEW_SECONDS


def finite(col: Column) -> Column:
    """The value as a double if it is a finite number, else NULL. Text that is no number is NULL too."""
    d = col.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def is_number(col: Column, minimum: float | None = 0) -> Column:
    d = finite(col)
    ok = d.isNotNull()
    return ok if minimum is None else ok & F.coalesce(d >= minimum, F.lit(False))


def fraction(col: Column) -> Column:
    """A share in [0, 1], else NULL."""
    d = finite(col)
    return F.when((d >= 0) & (d <= 1), d)


def clamp(col: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``least`` and ``greatest`` alone would turn it into a bound)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def holds(condition: Column) -> Column:
    """True only if the condition is known to hold: NULL counts as not holding."""
    return F.coalesce(condition, F.lit(False))


def age_ok(now: Column, at: Column, limit) -> Column:
    """Small clock skew into the future is tolerated; a missing time is not."""
    return holds((now - at).between(-CLOCK_SKEW_SECONDS, limit))


def freshness(now: Column, at: Column, limit) -> Column:
    return (F.when(at.isNull(), "unknown")
            .when((now - at).between(-CLOCK_SKEW_SECONDS, limit), "fresh").otherwise("stale"))
