"""Column builders for dates and ages as clerks write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")


def iso_date(c: Column) -> Column:
    """A date from the first ten characters of an ISO text; null if there is none (29 February of a common year too)."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def _from_parts(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def clerk_date(c: Column, pivot: int = 25) -> Column:
    """d.m.yy or d/m/yyyy; two-digit years from the pivot on are 19yy, below it 20yy."""
    shape = r"^\s*([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4}|[0-9]{2})\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, shape, k), F.lit("")).cast("int")
    y = part(3)
    year = F.when(y >= 100, y).when(y >= pivot, y + 1900).otherwise(y + 2000)
    return _from_parts(year, part(2), part(1))


def roman_date(c: Column, pivot: int = 25, default_year: Column | None = None) -> Column:
    """28-VIII-40: the month in Roman numerals; a missing year is the default one."""
    shape = r"^\s*([0-9]{1,2})[-./ ]([ivxIVX]+)(?:[-./ ]([0-9]{4}|[0-9]{2}))?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, shape, k), F.lit(""))
    month = F.nullif(F.array_position(F.array(*map(F.lit, ROMAN)), F.lower(part(2))), F.lit(0)).cast("int")
    y = part(3).cast("int")
    year = F.when(y >= 100, y).when(y >= pivot, y + 1900).when(y.isNotNull(), y + 2000)
    return _from_parts(F.coalesce(year, default_year) if default_year is not None else year, month, part(1).cast("int"))


def shift_years(d: Column, years: Column | int) -> Column:
    """The same month and day some years on; null where 29 February has none."""
    years = F.lit(years) if isinstance(years, int) else years
    return _from_parts(F.year(d) + years, F.month(d), F.dayofmonth(d))


def age_years(value: Column, unit: Column) -> Column:
    """Age in years from a number and its unit (days, weeks, months, else years)."""
    return in_years(F.when(F.trim(value).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(value).cast("double")), unit)


def in_years(n: Column, unit: Column) -> Column:
    """Years from a number of days, weeks, months, else years; null below zero."""
    n, u = F.when(n >= 0, n), F.lower(F.trim(unit))
    return F.when(u.startswith("d"), n / 365.25).when(u.startswith("w"), n * 7 / 365.25).when(u.startswith("m"), n / 12).otherwise(n)


def band(c: Column, width: int) -> Column:
    """The lower end of the band of equal width."""
    return (F.floor(c / width) * width).cast("long")


def month_number(d: Column) -> Column:
    """Months since year 0 with the day as a fraction of its month."""
    return F.year(d) * 12 + F.month(d) + (F.dayofmonth(d) - 1) / F.dayofmonth(F.last_day(d))


def witness(first: Column, second: Column, reported: Column, years: int = -1) -> Column:
    """The second date as it is or shifted by some years, whichever makes the stay nearer to the reported one; as it is on a tie."""
    other = shift_years(second, years)
    gap = lambda d: F.abs(F.datediff(d, first) - reported)
    return F.when(other.isNotNull() & (gap(other) < gap(second)), other).otherwise(second)


def repair_year(d: Column, other: Column, low: int, high: int) -> Column:
    """A date whose year is out of [low, high] takes the year of the row's other date; one year more or less where the order asks for it."""
    same = shift_years(d, F.year(other) - F.year(d))
    fixed = F.when(same > F.date_add(other, 183), shift_years(same, -1)).when(same < F.date_sub(other, 183), shift_years(same, 1)).otherwise(same)
    return F.when(F.year(d).between(low, high), d).otherwise(fixed)
