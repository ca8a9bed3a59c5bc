"""Table operators of a ledger's curation: audits, rare values, coverage, occupancy, seats of years, places and their districts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def audit(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(kind, column, from, to, records): the changes of cells between two states of a table, equal ones counted, the most frequent first.

    kind: filled, cleared or changed. Rows of equal records are ordered by column, from and to."""
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"b.`{c}`").cast("string").alias("from"), F.col(f"a.`{c}`").cast("string").alias("to"))
    both = before.alias("b").join(after.alias("a"), key).select(F.inline(F.filter(F.array(*map(pair, columns)), lambda x: ~x["from"].eqNullSafe(x["to"]))))
    kind = F.when(F.col("from").isNull(), "filled").when(F.col("to").isNull(), "cleared").otherwise("changed")
    return both.groupBy(kind.alias("kind"), "column", "from", "to").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "column", "from", "to")


def correction_deltas(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], group: Column) -> DataFrame:
    """(value, records, and for each column how many were filled, cleared or changed): group is read from the state before."""
    told = lambda c: (F.col(f"b.`{c}`"), F.col(f"a.`{c}`"))
    counts = []
    for c in columns:
        old, new = told(c)
        counts += [
            F.count_if(old.isNull() & new.isNotNull()).alias(f"{c}_filled"),
            F.count_if(old.isNotNull() & new.isNull()).alias(f"{c}_cleared"),
            F.count_if(old != new).alias(f"{c}_changed"),
        ]
    slim = before.select(key, *columns, group.alias("_value")).alias("b")
    return slim.join(after.select(key, *columns).alias("a"), key).groupBy(F.col("_value").alias("value")).agg(F.count("*").alias("records"), *counts)


def rare_values(df: DataFrame, column: str, below: int = 5) -> DataFrame:
    """df with rare: whether the value of the column occurs less often than that. Null values are not rare.

    The counts are joined back, and Spark chooses how by their size: a window by the value would put a hot one in one task."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg((F.count("*") < below).alias("rare"))
    return df.join(n, F.col(column) == F.col("_value"), "left").drop("_value").withColumn("rare", F.coalesce("rare", F.lit(False)))


def page_state(df: DataFrame, page: Sequence[str], filled: Column) -> DataFrame:
    """(page, n, filled, state): all, none or mixed, by how many of a page's rows are filled."""
    out = df.groupBy(*page).agg(F.count("*").alias("n"), F.count_if(filled).alias("filled"))
    return out.withColumn("state", F.when(F.col("filled") == 0, "none").when(F.col("filled") == F.col("n"), "all").otherwise("mixed"))


def occupancy(stays: DataFrame, group: str, start: str, end: str, beds: int, most: int = 400) -> DataFrame:
    """(group, stays, bed_days, days, occupancy): nights of the stays of 0 to most - 1 days, over the days from first to last start."""
    nights = F.datediff(end, start)
    ok = stays.where((nights >= 0) & (nights < most))
    out = ok.groupBy(group).agg(F.count("*").alias("stays"), F.sum(nights).alias("bed_days"), (F.datediff(F.max(start), F.min(start)) + 1).alias("days"))
    return out.withColumn("occupancy", F.col("bed_days") / (F.col("days") * beds))


def stock_flow(df: DataFrame, group: str, cell: str) -> DataFrame:
    """(group, total, numbers, dashes, blanks): a cell is a number, a dash that stands for 0, or blank and not counted."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    number = F.expr(f"try_cast(replace(trim(`{cell}`), ',', '') AS BIGINT)")
    dash = text.isin("-", "–")
    out = df.groupBy(group).agg(F.sum(F.when(dash, 0).otherwise(number)).alias("total"), F.count(number).alias("numbers"), F.count_if(dash).alias("dashes"), F.count_if(text == "").alias("blanks"))
    return out


def carried_heading(df: DataFrame, book: str, order: str, heading: Column, look_back: Column, reach: int = 2) -> DataFrame:
    """df with heading (the last one at or before the row) and near (the nearest value of look_back within reach rows, itself first)."""
    w = W.partitionBy(book).orderBy(order)
    return df.withColumn("heading", F.last(heading, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("near", F.last(look_back, ignorenulls=True).over(w.rowsBetween(-reach, 0)))


def seat_in_span(year: Column, span: Column) -> Column:
    """The year if the span (array of years) has it, else the nearest of the span; of two equally near the earlier one."""
    nearest = F.array_min(F.transform(span, lambda y: F.struct(F.abs(y - year).alias("gap"), y.alias("year"))))["year"]
    return F.when(F.array_contains(span, year), year).otherwise(nearest)


def serial_witness(df: DataFrame, book: str, serial: str, set_aside: str) -> DataFrame:
    """df with moved: serial + 1 where a row set that number aside and no row of the book holds it; else the serial."""
    held = df.select(F.col(book).alias("_book"), (F.col(serial) - 1).alias("_before")).distinct().withColumn("_held", F.lit(True))
    out = df.join(held, (F.col(book) == F.col("_book")) & (F.col(serial) == F.col("_before")), "left")
    told = F.coalesce(F.array_contains(set_aside, F.col(serial) + 1), F.lit(False)) & F.col("_held").isNull()
    return out.withColumn("moved", F.when(told, F.col(serial) + 1).otherwise(F.col(serial))).drop("_book", "_before", "_held")


def around(events: DataFrame, series: DataFrame, key: str, day: str, reach: int = 60) -> DataFrame:
    """events (key, day, others) with cases, and covered: the sum of series (key, day, n) within reach days, and whether there is any.

    The days of both go into one window by key with a frame of days: no row is joined with many."""
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    a = events.select(F.col(key).alias("_key"), at.alias("_at"), F.struct("*").alias("_event"), F.lit(None).cast("long").alias("_n"))
    # One row a day; cases of a day are summed before.
    b = series.groupBy(F.col(key).alias("_key"), at.alias("_at")).agg(F.sum("n").alias("_n"))
    b = b.select("_key", "_at", F.lit(None).cast(a.schema["_event"].dataType).alias("_event"), "_n")
    w = W.partitionBy("_key").orderBy("_at").rangeBetween(-reach, reach)
    both = a.unionAll(b).withColumns({"cases": F.coalesce(F.sum("_n").over(w), F.lit(0)), "covered": F.count("_n").over(w) > 0})
    return both.where("_event IS NOT NULL").select("_event.*", "cases", "covered")


def uncovered(reports: DataFrame, covered: DataFrame, key: str, day: str) -> DataFrame:
    """The reports whose month is none of the covered months (key, month) of their key."""
    return reports.withColumn("month", F.trunc(day, "month").cast("date")).join(covered, [key, "month"], "left_anti")


def merge_entities(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], gathered: Sequence[str] = ()) -> DataFrame:
    """One row per key of either source: fields of a, or else of b; gathered arrays of both together; in: which source has it."""
    one = F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)
    held = F.when(F.col(f"b.{key}").isNull(), "a").when(F.col(f"a.{key}").isNull(), "b").otherwise("both").alias("in")
    first = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in fields]
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    union = [F.array_sort(F.array_union(none(F.col(f"a.{c}")), none(F.col(f"b.{c}")))).alias(c) for c in gathered]
    return a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(one, *first, *union, held)


def span_conflicts(df: DataFrame, page: str, year: Column, low: str, high: str) -> DataFrame:
    """(page, n, outside, verdict): rows whose year lies outside the span of their page's volume; whole page, some or none."""
    out = df.groupBy(page).agg(F.count("*").alias("n"), F.count_if(~year.between(F.col(low), F.col(high))).alias("outside"))
    return out.withColumn("verdict", F.when(F.col("outside") == F.col("n"), "whole page").when(F.col("outside") > 0, "some").otherwise("none"))


def two_sources(a: DataFrame, b: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, share_a, share_b, agree): the shares of groups in two tables, and whether they differ by tolerance at most."""
    share = lambda df, name: df.groupBy(group).count().withColumn(name, F.col("count") / F.sum("count").over(W.partitionBy())).drop("count")  # noqa: E731  one row per group
    both = share(a, "share_a").join(share(b, "share_b"), group, "full").na.fill(0.0, ["share_a", "share_b"])
    return both.withColumn("agree", F.abs(F.col("share_a") - F.col("share_b")) <= tolerance)


def district_verdict(written: Column, own: Column, others: Column, sources: Column | None = None) -> Column:
    """What the district written beside a place says of the place's own: ok, absent, homonym (a place of the name lies there) or mismatch.

    sources: the districts that other sources give the place; where these do not agree it is a source conflict, whatever is written."""
    said = F.lit(0) if sources is None else F.size(F.array_distinct(F.filter(sources, lambda x: x.isNotNull())))
    return F.when(said > 1, "source conflict").when(written.isNull(), "absent").when(written == own, "ok").when(F.array_contains(others, written), "homonym").otherwise("mismatch")


def last_marked(c: Column, pattern: str) -> Column:
    """What the last match of the pattern's group in a text says; null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def single_place(address: Column, places: Sequence[str], street: str = r"(?i)\b(street|st|road|rd)\b\.?", split: str = r"\s*,\s*") -> Column:
    """The only known place among the segments of an address, streets left out; null if there is none or more than one."""
    known = F.array(*map(F.lit, places))
    found = F.array_distinct(F.filter(F.split(address, split), lambda s: F.array_contains(known, s) & ~s.rlike(street)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def canonical(df: DataFrame, key: Column, spelling: str) -> DataFrame:
    """(key, canonical, records): of the spellings of a key the commonest, of these the longest, then the first by name."""
    n = df.where(F.col(spelling).isNotNull()).groupBy(key.alias("key"), F.col(spelling).alias("s")).agg(F.count("*").alias("n"))
    rank = F.min(F.struct((-F.col("n")).alias("n"), (-F.length("s")).alias("size"), "s"))
    return n.groupBy("key").agg(rank["s"].alias("canonical"), F.sum("n").alias("records"))


def decisions(values: DataFrame, value: str, manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """(value, records, target, by): the decision of each value; manual ones (value, target) before automatic ones; else missing."""
    n = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("records"))
    out = n.join(manual.select(value, F.col("target").alias("_m")), value, "left").join(automatic.select(value, F.col("target").alias("_a")), value, "left")
    by = F.when(F.col("_m").isNotNull(), "manual").when(F.col("_a").isNotNull(), "auto").otherwise("missing")
    return out.select(value, "records", F.coalesce("_m", "_a").alias("target"), by.alias("by"))


def work_queue(df: DataFrame, value: str, mix: str, least: int) -> DataFrame:
    """(value, records, mix): the undecided values of least records or more, with how often each value of mix occurs beside it."""
    part = df.groupBy(value, mix).agg(F.count("*").alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.coalesce(mix, F.lit("")).alias("m")))), lambda x: F.concat(x["m"], F.lit(" "), (-x["n"]).cast("string"))), "; ")
    return part.groupBy(value).agg(F.sum("n").alias("records"), told.alias("mix")).where(F.col("records") >= least)


def unmapped(df: DataFrame, value: Column, decided: DataFrame, key: str) -> DataFrame:
    """(why, records): why rows have no place on a map: no value, no decision for it, or a decision for none; mapped ones too."""
    held = decided.select(F.col(key).alias("_value"), F.col("target").alias("_target"), F.lit(True).alias("_decided"))
    why = F.when(F.col("_v").isNull(), "no value").when(F.col("_decided").isNull(), "undecided").when(F.col("_target").isNull(), "decided none").otherwise("mapped")
    return df.select(value.alias("_v")).join(held, F.col("_v") == F.col("_value"), "left").groupBy(why.alias("why")).agg(F.count("*").alias("records"))


def suppressed_rate(df: DataFrame, group: Column, hit: Column, least: int) -> DataFrame:
    """(value, n, hits, rate): the rate is null for groups of fewer than least rows."""
    out = df.groupBy(group.alias("value")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("rate", F.when(F.col("n") >= least, F.col("hits") / F.col("n")))
