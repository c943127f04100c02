"""Days since the genesis date, spells and ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Day 0 of ``daysSinceFirstEvent``.
GENESIS = "1971-12-30"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_since_genesis(date) -> Column:
    return F.datediff(_c(date).cast("date"), F.lit(GENESIS).cast("date"))


def date_of_day(days) -> Column:
    return F.date_add(F.lit(GENESIS).cast("date"), _c(days).cast("int"))


def integer_age(date, birthday) -> Column:
    """Full years as the corpus counts them: one less while the month end after the date lies before the birthday in the year."""
    d, b = _c(date).cast("date"), _c(birthday).cast("date")
    return F.year(d) - F.year(b) - (F.dayofyear(F.last_day(F.date_add(d, 1))) < F.dayofyear(b)).cast("int")


def full_months(later, earlier) -> Column:
    return F.floor(F.months_between(_c(later).cast("date"), _c(earlier).cast("date"))).cast("int")


def parse_date(text, pattern: str) -> Column:
    """Null where the text doesn't follow the pattern."""
    return F.to_date(F.try_to_timestamp(_c(text), F.lit(pattern)))


def date_of_sas_day(days) -> Column:
    """Day 0 is 1960-01-01."""
    return F.date_add(F.lit("1960-01-01").cast("date"), _c(days).cast("int"))


def num_months(later, earlier) -> Column:
    """Full months by year, month and day of the month."""
    a, b = _c(later).cast("date"), _c(earlier).cast("date")
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b) - (F.dayofmonth(a) < F.dayofmonth(b)).cast("int")


def add_years(date, years: int) -> Column:
    """The same day some years on; 29 February becomes 1 March where the year has none."""
    d = _c(date).cast("date")
    moved = F.add_months(d, 12 * years)
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29) & (F.dayofmonth(moved) != 29), F.date_add(moved, 1)).otherwise(moved)


def bounded_age(date, birthday, least: int = 0, most: int | None = None) -> Column:
    """Full years between two days; null outside the bounds."""
    years = F.floor(num_months(date, birthday) / 12).cast("int")
    fine = years >= least if most is None else years.between(least, most)
    return F.when(fine, years)
