"""Numeric and date column expressions.

Missing values are NULL throughout; a comparison with NULL never holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditlens import schemas as S

INFINITY = float("inf")


def missing_to_null(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def parse_day_first(c: Column) -> Column:
    """Text dd-MM-yyyy to a date; null if it is none."""
    return F.try_to_timestamp(c, F.lit("dd-MM-yyyy")).cast("date")


def whole_years(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end`` in years of 364 days, rounded half to even."""
    return F.bround(F.datediff(end, start) / F.lit(float(S.DAYS_PER_YEAR)), 0)


def whole_years_between_times(start: Column, end: Column) -> Column:
    """As ``whole_years`` for timestamps: the days are floored first."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.bround(F.floor(seconds / F.lit(86400.0)) / F.lit(float(S.DAYS_PER_YEAR)), 0)


def not_below(c: Column, low) -> Column:
    return F.when(c < low, F.lit(low).cast("double")).otherwise(c)


def not_above(c: Column, high) -> Column:
    return F.when(c > high, high).otherwise(c)


def default_flag(c: Column) -> Column:
    """Collectibility above 2 is a default."""
    return F.when(c > 2, 1).when(c <= 2, 0)


def is_positive(c: Column) -> Column:
    return F.when(c > 0, 1).otherwise(0)


def side_business(flag: Column, side_income: Column) -> Column:
    """The flag if positive, else 1 for any side income, else 0."""
    return F.when(flag > 0, flag).when(side_income > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    """n / d where a zero divisor gives a signed infinity, and NULL for 0 / 0."""
    return (
        F.when(d != 0, n / F.when(d != 0, d))
        .when((d == 0) & (n > 0), F.lit(INFINITY))
        .when((d == 0) & (n < 0), F.lit(-INFINITY))
    )


def capped_ratio(n: Column, d: Column, cap: float = S.MAX_INCOME_RATIO) -> Column:
    r = ratio(n, d)
    return F.when(r > cap, F.lit(float(cap))).otherwise(r)


def at_least(score: Column, cutoff: float) -> Column:
    """Hard label of the reports: 1 from the cutoff on."""
    return (score >= cutoff).cast("int")


def above(score: Column, threshold: float) -> Column:
    """Hard label of confusion counts and accuracy: 1 strictly above the threshold."""
    return (score > threshold).cast("int")
