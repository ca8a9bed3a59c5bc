"""Decisions and what follows from them: slips of two dates, exceptions, changes, tallies by precedence, queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settled_dates(was_start: Column, was_end: Column, start: Column, end: Column) -> Column:
    """A struct (start, end, rule) of two dates after a second reading, given what they were before.

    follows: only the start was read again, in another year but on the same day, and the end now lies before it: the end moves by
    the same years, if it then follows within a year. kept: the end lies before the start, though the two were in order before: both stay as they
    were. read: the new reading as it is. same: nothing was read again. A date that is null is in no order.
    """
    new_start, new_end = ~start.eqNullSafe(was_start), ~end.eqNullSafe(was_end)
    years = F.year(start) - F.year(was_start)
    moved = F.add_months(end, years * 12)
    same_day = (F.month(start) == F.month(was_start)) & (F.dayofmonth(start) == F.dayofmonth(was_start)) & (years != 0)
    follows = new_start & ~new_end & same_day & (end < start) & (moved >= start) & (F.datediff(moved, start) < 366)
    kept = (new_start | new_end) & (end < start) & (was_end >= was_start)
    pick = lambda a, b, rule: F.struct(a.alias("start"), b.alias("end"), F.lit(rule).alias("rule"))
    return (
        F.when(F.coalesce(follows, F.lit(False)), pick(start, moved, "follows"))
        .when(F.coalesce(kept, F.lit(False)), pick(was_start, was_end, "kept"))
        .when(new_start | new_end, pick(start, end, "read"))
        .otherwise(pick(start, end, "same"))
    )


#: Exceptions up to which they are broadcast (keys and cells of single records, written by hand); more are joined.
EXCEPTIONS = 10_000


def with_exceptions(df: DataFrame, exceptions: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with the cells that single records are given by hand: exceptions (key, column, value), value null for an empty cell.

    Two exceptions for one cell are an error."""
    per = exceptions.groupBy(key).agg(
        *(F.max(F.when(F.col("column") == c, F.struct(F.col("value").alias("v"), F.lit(1).alias("is")))).alias(f"_{c}") for c in columns),
        F.max(F.when(F.col("column").isin(*columns), 0).otherwise(1)).alias("_unknown"),
    )
    repeated = exceptions.groupBy(key, "column").count().where("count > 1")
    if not repeated.isEmpty() or not per.where("_unknown = 1").isEmpty():
        raise ValueError("an exception is given twice, or for a column that is not named")
    per = per.drop("_unknown")
    out = df.join(F.broadcast(per) if exceptions.count() <= EXCEPTIONS else per, key, "left")
    of = lambda c: F.when(F.col(f"_{c}.is") == 1, F.col(f"_{c}.v").try_cast(dict(df.dtypes)[c])).otherwise(F.col(c)).alias(c)
    return out.select(*(of(c) if c in columns else F.col(c) for c in df.columns))


def change_dates(df: DataFrame, key: Sequence[str], date: str, value: str) -> DataFrame:
    """(key, first, last, changes): when a key's value first and last became another than on its row before, by date; keys that never change are out.

    Rows of one day are ordered by value."""
    w = W.partitionBy(*key).orderBy(date, value)
    rows = df.where(F.col(date).isNotNull()).select(*key, F.col(date).alias("d"), (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).alias("new"))
    return rows.where("new").groupBy(*key).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("changes"))


def trimmed(counts: DataFrame, keys: Sequence[str], period: str, n: str, floor: int = 5) -> DataFrame:
    """The rows of counts between the first and the last period of a key that has floor or more; what lies between stays, however little."""
    ends = counts.where(F.col(n) >= floor).groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_z"))
    rows = counts.join(ends, list(keys)) if keys else counts.crossJoin(F.broadcast(ends))  # one row
    return rows.where(F.col(period).between(F.col("_a"), F.col("_z"))).select(*counts.columns)


def verdict_tally(df: DataFrame, verdict: Column, precedence: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, verdict, n, place): counts by verdict; place is its rank in the precedence, the others come after, by name."""
    known = F.array(*map(F.lit, precedence))
    n = df.groupBy(*group, verdict.alias("verdict")).agg(F.count("*").alias("n"))
    at = F.array_position(known, F.col("verdict"))
    place = F.when(at > 0, at).otherwise(len(precedence) + F.dense_rank().over(W.partitionBy(*group, F.when(at > 0, 1).otherwise(0)).orderBy(F.col("verdict").asc_nulls_last())))  # a row a verdict
    return n.withColumn("place", place.cast("long"))


def lanes(df: DataFrame, a: str, b: str, values: Sequence[str], measure: Column | None = None) -> DataFrame:
    """A row for each value of a, a column for each of the given values of b, what remains as "others", and the total."""
    what = F.lit(1) if measure is None else measure
    cells = [F.sum(F.when(F.col(b) == v, what).otherwise(0)).alias(v) for v in values]
    rest = F.sum(F.when(F.coalesce(F.col(b).isin(*values), F.lit(False)), 0).otherwise(what)).alias("others")
    return df.groupBy(a).agg(*cells, rest, F.sum(what).alias("total"))


def bundles(questions: DataFrame, records: DataFrame, question: str, values: str, value: str) -> DataFrame:
    """(question, values, known, records) for each question: how many values its list names, how many of these any record has, and their records."""
    each = questions.select(question, F.explode(F.array_distinct(values)).alias(value))
    n = records.groupBy(value).agg(F.count("*").alias("n"))
    per = each.join(n, value, "left").groupBy(question).agg(F.count("*").alias("values"), F.count("n").alias("known"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    return questions.select(question).join(per, question, "left").na.fill(0, ["values", "known", "records"])


def review_queue(values: DataFrame, value: str, *queues: tuple[str, DataFrame]) -> DataFrame:
    """values with queue: the first of the named tables that has the value, else "unreviewed"."""
    out = values
    for k, (_, df) in enumerate(queues):
        out = out.join(df.select(F.col(value), F.lit(True).alias(f"_q{k}")).distinct(), value, "left")
    name = F.coalesce(*(F.when(F.col(f"_q{k}"), F.lit(n)) for k, (n, _) in enumerate(queues)), F.lit("unreviewed"))
    return out.select(*values.columns, name.alias("queue"))


def namesake(address: Column, city: Column) -> Column:
    """The city, but null where the address only has it as a street's name."""
    text, name = F.lower(address), F.lower(city)
    street = F.concat(F.lit(r"\Q"), name, F.lit(r"\E\s+(?:street|st|road|rd)\b"))
    only = F.rlike(text, street) & ~F.contains(F.regexp_replace(text, street, F.lit("")), name)
    return F.when(~F.coalesce(only, F.lit(False)), city)


def cell(df: DataFrame, name: str) -> Column:
    """A column's trimmed text, empty for null, and empty if the table has no such column."""
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def with_group(df: DataFrame, name: str, group: Column, needs: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """df with a derived column, where it has all columns that it needs and none of that name; else df as it is."""
    return df.withColumn(name, group) if name not in df.columns and all(c in df.columns for c in needs) else df
