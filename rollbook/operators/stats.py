"""Statistics over selections: shares, lift, cross-tabulation, stays, composition, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import UNKNOWN, facet_value
from ..functions.intervals import Z, byar, wilson


def top_or_others(base: DataFrame, rows: DataFrame, key: str, top: int, others: str = "Others", floor: float = 0.0) -> DataFrame:
    """(value, n, share): counts on rows of the values that rank first on base; the rest and shares below floor as others, unknown apart.

    The ranking is on the whole data, the counting on the selection. Rank ties go by name.
    """
    ranks = base.groupBy(facet_value(F.col(key)).alias("v")).agg(F.count("*").alias("c")).where(F.col("v") != UNKNOWN)
    ranks = ranks.orderBy(F.desc("c"), "v").limit(top).select("v", F.lit(True).alias("named"))
    counted = rows.groupBy(facet_value(F.col(key)).alias("v")).agg(F.count("*").alias("c"))
    all_ = W.partitionBy()
    named = counted.join(F.broadcast(ranks), "v", "left").withColumn("share", F.col("c") / F.sum("c").over(all_))
    keep = (F.col("v") == UNKNOWN) | (F.coalesce("named", F.lit(False)) & (F.col("share") >= floor))
    out = named.groupBy(F.when(keep, F.col("v")).otherwise(F.lit(others)).alias("value")).agg(F.sum("c").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(all_))


def share_lift(base: DataFrame, selection: Column, key: str) -> DataFrame:
    """(value, n, share, base_share, lift) of each value in the selection against the base; one scan of the base."""
    v = facet_value(F.col(key)).alias("value")
    counts = base.groupBy(v).agg(F.count_if(selection).alias("n"), F.count("*").alias("base_n"))
    all_ = W.partitionBy()
    share, base_share = F.try_divide("n", F.sum("n").over(all_)), F.col("base_n") / F.sum("base_n").over(all_)
    return counts.select("value", "n", share.alias("share"), base_share.alias("base_share"), (share / base_share).alias("lift"))


def representation(base: DataFrame, selection: Column, key: str, year: Column) -> DataFrame:
    """Observed against expected counts of each value in the selection, with Byar's limits, plain and standardised by year.

    The standard expectation applies each year's selection rate to the value's rows of that year; rows without a year count
    only in the plain one. One scan: counts by value and year, then sums of these.
    """
    cells = base.groupBy(facet_value(F.col(key)).alias("value"), year.alias("y")).agg(F.count("*").alias("m"), F.count_if(selection).alias("k"))
    by_year, all_ = W.partitionBy("y"), W.partitionBy()
    rate = F.sum("k").over(by_year) / F.sum("m").over(by_year)
    cells = cells.withColumn("std", F.when(F.col("y").isNotNull(), F.col("m") * rate))
    rows = cells.groupBy("value").agg(F.sum("k").alias("observed"), F.sum("m").alias("registry_n"), F.sum("std").alias("expected_std"))
    rows = rows.withColumn("expected", F.sum("observed").over(all_) * (F.col("registry_n") / F.sum("registry_n").over(all_)))
    lo, hi = byar(F.col("observed"), F.col("expected"))
    some = F.col("expected_std") > 0
    lo_std, hi_std = byar(F.col("observed"), F.col("expected_std"))
    return rows.select(
        "value",
        "observed",
        "registry_n",
        "expected",
        F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).otherwise(0.0).alias("lift"),
        lo.alias("lo"),
        hi.alias("hi"),
        "expected_std",
        F.when(some, F.col("observed") / F.col("expected_std")).alias("lift_std"),
        F.when(some, lo_std).alias("lo_std"),
        F.when(some, hi_std).alias("hi_std"),
    )


def crosstab(df: DataFrame, row: str, col: str, rows: Sequence[str] | None = None, cols: Sequence[str] | None = None, min_n: int = 20) -> DataFrame:
    """(row, col, observed, expected, ratio, row_share) for every pair of values that occur; ratio null below min_n."""
    cells = df.groupBy(facet_value(F.col(row)).alias("row"), facet_value(F.col(col)).alias("col")).agg(F.count("*").alias("observed"))
    if rows is not None:
        cells = cells.where(F.col("row").isin(*rows))
    if cols is not None:
        cells = cells.where(F.col("col").isin(*cols))
    # The axes have as many values as the two columns; the grid of them is the result's own size.
    grid = cells.groupBy("row").agg(F.sum("observed").alias("row_n")).crossJoin(cells.groupBy("col").agg(F.sum("observed").alias("col_n")))
    grid = grid.join(cells, ["row", "col"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    total = F.sum("observed").over(W.partitionBy())
    grid = grid.withColumn("expected", F.col("row_n") * F.col("col_n") / total)
    ratio = F.when((F.col("observed") >= min_n) & (F.col("expected") > 0), F.col("observed") / F.col("expected"))
    return grid.select("row", "col", "observed", "expected", ratio.alias("ratio"), (F.col("observed") / F.col("row_n")).alias("row_share"))


def compare_stays(df: DataFrame, group: str, days: str, strata: Sequence[str] = ()) -> DataFrame:
    """Quantiles of the stays of each group, and the ratio of its geometric mean to the whole's or to its strata's, with limits.

    Negative and missing stays are left out. With strata, a row is compared with its stratum's mean, if all of the strata
    are known and the stratum has at least two rows.
    """
    rows = df.where(F.col(days) >= 0).select(facet_value(F.col(group)).alias("name"), F.col(days).cast("double").alias("d"), *strata)
    rows = rows.withColumn("_log", F.log1p("d"))
    if strata:
        means = rows.where(" AND ".join(f"{s} IS NOT NULL" for s in strata)).groupBy(*strata).agg(F.avg("_log").alias("_mean"), F.count("*").alias("_n"))
        rows = rows.join(means, list(strata), "left").withColumn("r", F.when(F.col("_n") >= 2, F.col("_log") - F.col("_mean")))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("_log").alias("_mean")))).withColumn("r", F.col("_log") - F.col("_mean"))  # one row
    out = rows.groupBy("name").agg(
        F.count("*").alias("n"),
        F.percentile("d", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q"),
        F.count_if(F.col("d") > 365).alias("over_year"),
        F.count("r").alias("compared"),
        F.avg("r").alias("m"),
        F.stddev_samp("r").alias("s"),
    )
    half = Z * F.col("s") / F.sqrt("compared")
    enough = F.col("compared") >= 2
    return out.select(
        "name",
        "n",
        *(F.col("q")[k].alias(c) for k, c in enumerate(("p10", "q1", "median", "q3", "p90"))),
        "over_year",
        F.when(enough, F.exp("m")).alias("ratio"),
        F.when(enough, F.exp(F.col("m") - half)).alias("lo"),
        F.when(enough, F.exp(F.col("m") + half)).alias("hi"),
        "compared",
    )


def compose(df: DataFrame, date: str, key: str, grain: str) -> DataFrame:
    """(period, value, n, share) over every period between the first and the last: n null where a period has no row at all, 0
    where it has rows but none of the value."""
    at = F.trunc(F.col(date), grain)
    counts = df.where(F.col(date).isNotNull()).groupBy(at.alias("period"), facet_value(F.col(key)).alias("value")).agg(F.count("*").alias("c"))
    step = F.expr(f"interval 1 {grain}")
    spine = counts.agg(F.min("period").alias("a"), F.max("period").alias("z")).select(F.explode(F.sequence("a", "z", step)).alias("period"))
    totals = counts.groupBy("period").agg(F.sum("c").alias("total"))
    grid = spine.join(totals, "period", "left").crossJoin(F.broadcast(counts.select("value").distinct()))
    out = grid.join(counts, ["period", "value"], "left")
    n = F.when(F.col("total").isNotNull(), F.coalesce("c", F.lit(0)))
    return out.select("period", "value", n.alias("n"), (n / F.col("total")).alias("share"))


def profile(df: DataFrame, group: str, measures: Mapping[str, tuple[Column, Column]], floor: int = 10) -> DataFrame:
    """One row per group: n, and each measure's share (test among base), null where its base has fewer than floor rows."""
    aggs = [F.count("*").alias("n")]
    for name, (test, base) in measures.items():
        aggs.append(F.when(F.count_if(base) >= floor, F.count_if(test & base) / F.count_if(base)).alias(name))
    return df.groupBy(facet_value(F.col(group)).alias("value")).agg(*aggs)


def wilson_by(df: DataFrame, group: str, test: Column) -> DataFrame:
    """(value, k, n, share, lo, hi) of a test by group."""
    rows = df.groupBy(facet_value(F.col(group)).alias("value")).agg(F.count_if(test).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rows.select("value", "k", "n", (F.col("k") / F.col("n")).alias("share"), lo.alias("lo"), hi.alias("hi"))


def adjacency(df: DataFrame, partition: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """(pairs, same, same_share, by_chance): neighbours with equal values against the sum of squared shares."""
    w = W.partitionBy(*partition).orderBy(*order)
    pairs = df.select(F.col(key).alias("v"), F.lag(key).over(w).alias("before"))
    totals = pairs.agg(F.count("before").alias("pairs"), F.count_if(F.col("v") == F.col("before")).alias("same"))
    counts = df.groupBy(key).agg(F.count("*").alias("c"))
    chance = counts.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("by_chance"))
    return totals.crossJoin(F.broadcast(chance)).select("pairs", "same", F.try_divide("same", "pairs").alias("same_share"), "by_chance")


def most_frequent(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the commonest value of each key; of equal ones the one seen first in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "seen", value, "n")).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def coverage(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """(value, column, filled, n, share): how many cells of each column are filled, by group."""
    filled = lambda c: F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c)
    rows = df.groupBy(facet_value(F.col(group)).alias("value")).agg(F.count("*").alias("n"), *map(filled, columns))
    long = rows.unpivot(["value", "n"], list(columns), "column", "filled")
    return long.select("value", "column", "filled", "n", (F.col("filled") / F.col("n")).alias("share"))
