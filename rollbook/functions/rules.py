"""Column builders for the cleaning of a ledger's cells: places, flags, dates that depend on another cell. Rules by pattern: operators/ruled.py."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import vocabulary

def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def first_code(codes: Column) -> Column:
    """The first code of a list with bars."""
    return F.trim(F.split_part(_text(codes), F.lit("|"), F.lit(1)))


def place_name(c: Column, names: dict[str, str], noise: str) -> Column:
    """A place without what the noise pattern finds, spaces as one, by its usual name."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), noise, "")), r"\s{2,}", " ")
    return F.when(c == "", c).otherwise(vocabulary(plain, names))


def without_trailing(c: Column, tokens: str) -> Column:
    """A cell's words without the tokens at its end; the first word always stays."""
    words = F.concat_ws(" ", F.filter(F.split(F.replace(c, F.lit('"'), F.lit(" ")), r"\s+"), lambda w: w != ""))
    return F.when(c.isNotNull(), F.regexp_replace(words, rf"(?:\s{tokens})+$", ""))


def status(c: Column, none: str = r"^\s*$", open_: str = r"\?") -> Column:
    """absent, doubtful or recorded."""
    text = _text(c)
    return F.when(text.rlike(none), "absent").when(text.rlike(open_), "doubtful").otherwise("recorded")


def crossed_group(a: Column, b: Column, rules: Sequence[tuple[Sequence[str], Sequence[str], str]], default: str = "other") -> Column:
    """The group of two values together: the first rule (values of a, values of b, group) that holds both; no values: any."""
    out = None
    for left, right, group in rules:
        holds = (a.isin(*left) if left else F.lit(True)) & (b.isin(*right) if right else F.lit(True))
        out = F.when(holds, F.lit(group)) if out is None else out.when(holds, F.lit(group))
    return out.otherwise(F.lit(default))


def has_flag(flags: Column, flag: str, separator: str = r"\s*\|\s*") -> Column:
    """Whether a cell of flags holds this one as a whole token."""
    return F.array_contains(F.split(F.trim(_text(flags)), separator), flag)


def folded(c: Column, marks: str = "áàâäéèêëíìîïóòôöúùûüñç", plain: str = "aaaaeeeeiiiioooouuuunc", digits: str = "٠١٢٣٤٥٦٧٨٩") -> Column:
    """Lower case, letters without their marks, digits of another script as 0 to 9, everything else one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), marks + digits, plain + "0123456789"), "[^a-z0-9]+", " "))


def twin_date(parsed: Column, upstream: Column, locked: Column) -> Column:
    """A typed date again from the written one, the given one where that can't be read; a locked one comes first."""
    return F.coalesce(locked, parsed, upstream)


def reseated(own: Column, misfiled: Column, duplicate: Column, allowed: Sequence[str]) -> Column:
    """A cell of a vocabulary: its own value, else the duplicate's, else what stands in the wrong cell; null if none is one."""
    return F.coalesce(*(F.when(x.isin(*allowed), x) for x in (own, duplicate, misfiled)))


def gated(c: Column, date: Column, since: str, pattern: str, where: Column) -> Column:
    """What the pattern finds in a cell written from a day on, under a condition; else the cell."""
    found = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.when((date >= F.lit(since).cast("date")) & where, F.coalesce(found, c)).otherwise(c)


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_name_date(c: Column) -> Column:
    """A day with an English month name (4 March 1938) as a date; null if it is none."""
    part = lambda k: F.regexp_extract(F.lower(c), r"^\s*(\d{1,2})\.?\s+([a-z]+)\s+(\d{4})\s*$", k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2)).cast("int")
    first = F.make_date(F.nullif(part(3), F.lit("")).cast("int"), F.nullif(month, F.lit(0)), F.lit(1))
    day = F.nullif(part(1), F.lit("")).cast("int")
    return F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def written_range(c: Column) -> tuple[Column, Column]:
    """First and last day of 1938, 1938-07, 1938-07-06 or 6.7.1938; nulls for other texts."""
    text = F.trim(c)
    year = F.when(text.rlike(r"^\d{4}$"), F.make_date(text.cast("int"), F.lit(1), F.lit(1)))
    month = F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
    day = F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")), F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(text, "d.M.yyyy")))
    return F.coalesce(year, month, day), F.coalesce(F.last_day(F.add_months(year, 11)), F.last_day(month), day)
