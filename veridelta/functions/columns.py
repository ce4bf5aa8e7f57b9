"""Column expressions for calendars, rounding, ratios and distributions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def week_of(day: Column, first_monday: str) -> Column:
    """1-based week counted from a fixed Monday; days before it get 0 and less."""
    return (F.floor(F.datediff(day, F.lit(first_monday).cast("date")) / 7) + 1).cast("int")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_of_week(week: Column, first_monday: str) -> Column:
    """The month of a week's Monday."""
    return F.date_format(F.date_add(F.lit(first_monday).cast("date"), (week - 1) * 7), "yyyy-MM")


def mid_month_week(month: Column, first_monday: str) -> Column:
    """The week that holds the 15th of a month."""
    return week_of(F.to_date(F.concat(month, F.lit("-15"))), first_monday)


def last_day_of_month(month: Column) -> Column:
    return F.last_day(F.to_date(F.concat(month, F.lit("-01"))))


def half_even(x: Column, digits: int) -> Column:
    """Rounds ties to the even digit."""
    return F.bround(x, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def average_rank(by: list[str], order: str) -> Column:
    """Rank with ties averaged, as Spearman's coefficient needs it."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(order))
    return low + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / 2


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal.

    The distribution function is 1/2 plus the density times z + z^3/3 + z^5/(3 5) + ..., whose terms are all
    positive; 200 of them are enough for |z| < 12, and beyond that p is 0 in doubles.
    """
    a = F.abs(z)
    start = F.struct(a.alias("term"), a.alias("total"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * a * a / (k * 2 + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda s: s["total"])
    density = F.exp(-a * a / 2) / F.sqrt(2 * F.pi())
    return F.when(z.isNull() | F.isnan(z), F.lit(None).cast("double")).when(a > 12, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * density * total))


def power_law_between_ends(x: Column, y: Column) -> Column:
    """Aggregate exponent of y = scale * x ** exponent between the smallest and the largest x alone; null unless they differ and both have a positive y."""
    both = (x > 0) & (y > 0)
    at = F.when(both, x)
    rise = F.log(F.max_by(y, at)) - F.log(F.min_by(y, at))
    return rise / F.nullif(F.log(F.max(at)) - F.log(F.min(at)), F.lit(0.0))


def power_law(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Aggregates (exponent, scale, r2) of y = scale * x ** exponent by least squares on logarithms; points that aren't positive take no part."""
    both = (x > 0) & (y > 0)
    a, b = F.when(both, F.log(y)), F.when(both, F.log(x))
    return F.regr_slope(a, b), F.exp(F.regr_intercept(a, b)), F.regr_r2(a, b)
