"""Series by day: spines, runs, census, surges, spikes, clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import ln_poisson, log10_poisson_tail


def spine(df: DataFrame, date: str, grain: str = "day") -> DataFrame:
    """(period): every period between the first and the last of df."""
    ends = df.agg(F.min(F.trunc(F.col(date), grain) if grain != "day" else F.col(date)).alias("a"), F.max(F.trunc(F.col(date), grain) if grain != "day" else F.col(date)).alias("z"))
    return ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "z", F.expr(f"interval 1 {grain}"))).alias("period"))


def islands(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """(keys, first, last, days): runs of consecutive days of each key."""
    days = df.select(*keys, F.col(date).alias("d")).where("d IS NOT NULL").distinct()
    w = W.partitionBy(*keys).orderBy("d")
    run = F.date_sub("d", F.row_number().over(w))
    return days.withColumn("run", run).groupBy(*keys, "run").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("days")).drop("run")


def absent_periods(df: DataFrame, date: str, grain: str = "month") -> DataFrame:
    """(first, last, periods): runs of periods between the first and the last that have no row."""
    have = df.select(F.trunc(F.col(date), grain).alias("period")).distinct()
    gone = spine(df, date, grain).join(have, "period", "left_anti")
    number = F.year("period") * 12 + F.month("period") if grain == "month" else F.year("period")
    gone = gone.withColumn("k", number - F.row_number().over(W.orderBy("period")))  # one row per period
    return gone.groupBy("k").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("periods")).drop("k")


def _present(df: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """(keys, first, last, present): spans of days along which the number of half-open intervals [start, end) stays the same and above 0.

    A sweep: +1 at the start, -1 at the end, summed by day first, then along the days. An interval costs two rows whatever its length.
    """
    ok = df.where((F.col(end) > F.col(start)) & F.col(start).isNotNull())
    marks = ok.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("step")), F.struct(F.col(end).alias("day"), F.lit(-1).alias("step")))).alias("m"))
    daily = marks.groupBy(*keys, F.col("m.day").alias("day")).agg(F.sum("m.step").alias("step"))
    w = W.partitionBy(*keys).orderBy("day")
    level = daily.select(*keys, F.col("day").alias("first"), F.date_sub(F.lead("day").over(w), 1).alias("last"), F.sum("step").over(w).alias("present"))
    return level.where("present > 0")


def census(df: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """(day, keys, present): how many half-open intervals [start, end) hold each day."""
    return _present(df, start, end, keys).select(*keys, F.explode(F.sequence("first", "last")).alias("day"), "present")


def valid_months(days: DataFrame, day: str, keys: Sequence[str] = (), gap: int = 10, burn_in: int = 21, floor: int = 20) -> DataFrame:
    """(keys, month, valid_days): days of runs (a gap of so many days ends one) without each run's first days, by month, with enough of them."""
    d = days.select(*keys, F.col(day).alias("first"), F.col(day).alias("last")).distinct()  # one row per key and day
    return _valid_months(d, keys, gap, burn_in, floor)


def census_valid_months(df: DataFrame, start: str, end: str, keys: Sequence[str] = (), gap: int = 10, burn_in: int = 21, floor: int = 20) -> DataFrame:
    """valid_months of the days that some half-open interval [start, end) holds, from the ends of spans: no row per day is made."""
    return _valid_months(_present(df, start, end, keys), keys, gap, burn_in, floor)


def _valid_months(spans: DataFrame, keys: Sequence[str], gap: int, burn_in: int, floor: int) -> DataFrame:
    """valid_months of spans (keys, first, last) of days that don't overlap: what a run keeps of a span is cut at the months' ends."""
    w = W.partitionBy(*keys).orderBy("first")
    new = F.coalesce(F.datediff("first", F.lag("last").over(w)) >= gap, F.lit(True))
    runs = spans.select(*keys, "first", "last", F.when(new, F.col("first")).alias("opens"))
    runs = runs.withColumn("valid", F.greatest("first", F.date_add(F.max("opens").over(w), burn_in))).where("valid <= last")
    months = F.explode(F.sequence(F.trunc("valid", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))).alias("month")
    cut = runs.select(*keys, "valid", "last", months)
    n = F.datediff(F.least("last", F.last_day("month")), F.greatest("valid", "month")) + 1
    return cut.groupBy(*keys, "month").agg(F.sum(n).cast("long").alias("valid_days")).where(F.col("valid_days") >= floor)


def trailing_counts(df: DataFrame, date: str, key: str, trail: int = 30) -> DataFrame:
    """(key, day, n, trailing): rows of the day and of the last so many days, for every day that any key has (the open days)."""
    counts = df.groupBy(F.col(key).alias(key), F.col(date).alias("day")).agg(F.count("*").alias("n"))
    # The calendar is one row, an entry a day; each key's row lays it out, wherever that row is.
    calendar = df.where(F.col(date).isNotNull()).agg(F.array_sort(F.collect_set(date)).alias("days"))
    grid = counts.select(key).distinct().join(F.broadcast(calendar)).select(key, F.explode("days").alias("day"), F.lit(0).cast("long").alias("n"))
    grid = grid.unionByName(counts.where("day IS NOT NULL")).groupBy(key, "day").agg(F.sum("n").alias("n"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(key).orderBy("at").rangeBetween(-(trail - 1), 0)
    return grid.withColumn("at", number).select(key, "day", "n", F.sum("n").over(w).alias("trailing"))


def alarm_levels(trailing: DataFrame, key: str, floor: int = 5, share: float = 0.9) -> DataFrame:
    """(key, days, threshold): the value at index int(days * share) of the sorted trailing counts, floor at least."""
    ranked = trailing.groupBy(key).agg(F.count("*").alias("days"), F.sort_array(F.collect_list("trailing")).alias("s"))  # one entry per day
    at = F.floor(F.col("days") * F.lit(share)).cast("int")
    return ranked.select(key, "days", F.greatest(F.lit(floor).cast("long"), F.get("s", at)).alias("threshold"))


def surges(trailing: DataFrame, key: str, floor: int = 5, refractory: int = 60) -> DataFrame:
    """(key, day, trailing, threshold): the first day at or over the threshold, then the next one more than refractory days later, and so on.

    Which day counts depends on the one before it that did: a fold over the alarm days of one key (one row per day).
    """
    alarms = trailing.join(alarm_levels(trailing, key, floor), key).where("trailing >= threshold").select(key, "day", "trailing", "threshold")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        keep, last = [], None
        for day in rows["day"]:
            ok = last is None or (day - last).days > refractory
            keep.append(ok)
            last = day if ok else last
        return rows[keep]

    return alarms.groupBy(key).applyInPandas(fold, alarms.schema)


def spikes(daily: DataFrame, day: str, n: str, least: int, ratio: float = 3.0, span: int = 14) -> DataFrame:
    """(day, n, baseline): days with at least so many, and ratio times the mean of the days around (absent days count 0).

    Only days with enough other days around them (span // 2 of 2 * span + 1) are judged.
    """
    at = F.datediff(day, F.lit("1970-01-01").cast("date"))
    w = W.orderBy("at").rangeBetween(-span, span)  # one row per day
    rows = daily.withColumn("at", at).select(F.col(day).alias("day"), F.col(n).alias("n"), ((F.sum(n).over(w) - F.col(n)) / (2 * span)).alias("baseline"), F.count("*").over(w).alias("around"))
    ok = (F.col("around") >= span // 2) & (F.col("n") >= least) & (F.col("n") >= ratio * F.greatest("baseline", F.lit(0.5)))
    return rows.where(ok).select("day", "n", "baseline")


def clusters(df: DataFrame, keys: Sequence[str], day: str, window: int = 3, base: int = 365, least: int = 5, p: float = 1e-4) -> DataFrame:
    """(keys, start, end, n, mu, log10_p): windows with more rows than Poisson chance allows, given the days around them.

    Every row opens a window of so many days; its rate comes from the rows and the covered days (any key) within base days on
    either side. Counts are running sums over the days of a key; nothing is joined with itself.
    """
    num = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = df.where(F.col(day).isNotNull()).select(*keys, num.alias("at"))
    per = rows.groupBy(*keys, "at").agg(F.count("*").alias("c"))
    cover = rows.select("at").distinct()
    before = lambda w, a, z: w.rangeBetween(a, z)
    any_ = W.orderBy("at")  # one row per day
    cover = cover.select("at", F.count("*").over(before(any_, -base, -1)).alias("cov_before"), F.count("*").over(before(any_, window, window - 1 + base)).alias("cov_after"))
    w = W.partitionBy(*keys).orderBy("at")
    wide = per.select(
        *keys,
        "at",
        "c",
        F.sum("c").over(before(w, 0, window - 1)).alias("n"),
        F.sum("c").over(before(w, -base, window - 1 + base)).alias("around"),
        F.max("at").over(before(w, 0, window - 1)).alias("last"),
        F.sum("c").over(W.partitionBy(*keys)).alias("total"),
    )
    found = wide.where((F.col("n") >= least) & (F.col("total") >= least)).join(cover, "at")
    days = F.greatest(F.col("cov_before") + F.col("cov_after"), F.lit(1))
    mu = F.greatest((F.col("around") - F.col("n")) / days * window, window / days)
    # Most windows go by their first term, which the tail can't be below; the sum is made for the others only.
    found = found.withColumn("mu", mu).where((F.col("n") > F.col("mu")) & (ln_poisson(F.col("n"), F.col("mu")) < math.log(p)))
    found = found.withColumn("log10_p", log10_poisson_tail(F.col("n"), F.col("mu"))).where(F.col("log10_p") < math.log10(p))
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    return found.select(*keys, date("at").alias("start"), date("last").alias("end"), "n", "mu", "log10_p")


def merge_overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, slack: int = 1) -> DataFrame:
    """(keys, start, end, parts): intervals of a key that overlap, or lie within slack days, as one."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > F.date_add(reach, slack)).cast("int"), F.lit(1))
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts")).drop("_run")


def per_covered_month(df: DataFrame, date: str, group: Column) -> DataFrame:
    """(value, n, months, rate): rows per month that has rows."""
    out = df.groupBy(group.alias("value")).agg(F.count("*").alias("n"), F.countDistinct(F.trunc(F.col(date), "month")).alias("months"))
    return out.withColumn("rate", F.try_divide("n", "months"))
