"""What dimensions, subsets and two series say of each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linked_dimensions(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(a, b, values_a, values_b, pairs, a_gives_b, b_gives_a) for each two dimensions, in the order of dims.

    A dimension gives another if each of its values goes with one value of that: there are as many pairs as values. A comparison of the
    two is then circular, as a selection by one defines the other. Null counts as a value. One pass of grouping sets; what is shuffled are distinct
    pairs, combined before. Empty table: counts 0, and each gives the other.
    """
    pairs = list(combinations(range(len(dims)), 2))
    sets = [[dims[k]] for k in range(len(dims))] + [[dims[i], dims[j]] for i, j in pairs]
    named = df.select(*(F.col(c) for c in dims))
    seen = named.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in dims)).agg(F.grouping_id().alias("g"))
    counts = seen.groupBy("g").agg(F.count("*").alias("n"))
    mask = lambda *held: sum(0 if k in held else 1 << (len(dims) - 1 - k) for k in range(len(dims)))
    of = lambda *held: F.coalesce(F.max(F.when(F.col("g") == mask(*held), F.col("n"))), F.lit(0))
    one = counts.agg(F.array(*(F.struct(F.lit(dims[i]).alias("a"), F.lit(dims[j]).alias("b"), of(i).alias("values_a"), of(j).alias("values_b"), of(i, j).alias("pairs")) for i, j in pairs)).alias("r"))
    out = one.select(F.inline("r"))
    return out.withColumns({"a_gives_b": F.col("pairs") == F.col("values_a"), "b_gives_a": F.col("pairs") == F.col("values_b")})


def packed_days(df: DataFrame, date: str, facet: Column) -> DataFrame:
    """(facet, total, counts, present): for each value of the facet its rows by day, as an array along the open days.

    The open days are those that any row has, in order, so a day of no record has no entry and says nothing; a facet without rows on an open day has 0
    there. present is the same as runs of (first index, counts without zeros between). Days of a facet are counted before the shuffle
    and come as one row; its array is laid out along the calendar there, an entry a day, and no grid of facets and days is joined. Rows without a
    day are left out; a null facet is one of its own.
    """
    rows = df.select(facet.alias("facet"), F.col(date).alias("day")).where("day IS NOT NULL")
    daily = rows.groupBy("facet", "day").agg(F.count("*").alias("n"))
    calendar = daily.agg(F.array_sort(F.collect_set("day")).alias("days"))  # an entry a day
    per = daily.groupBy("facet").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("day", "n"))).alias("have"))
    # One merge of two sorted arrays: the next entry is taken where the day is its own.
    merged = F.aggregate(
        "days",
        F.struct(F.array().cast("array<bigint>").alias("counts"), F.lit(0).alias("at")),
        lambda acc, day: F.when(
            F.get("have", acc["at"])["day"] == day, F.struct(F.array_append(acc["counts"], F.get("have", acc["at"])["n"]).alias("counts"), (acc["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.array_append(acc["counts"], F.lit(0).cast("bigint")).alias("counts"), acc["at"].alias("at"))),
        lambda acc: acc["counts"],
    )
    return per.join(F.broadcast(calendar)).select("facet", "total", merged.alias("counts"), F.size("have").alias("present"))


def lead_lag(reports: DataFrame, marks: DataFrame, on: str, report_date: str, mark_date: str, most: int) -> DataFrame:
    """reports with gap: days from the nearest mark of the same key to the report, negative if the report comes first, null beyond most days.

    A mark on the day gives 0, of two as near the earlier one counts. Both tables go through one window for each key, where the last mark
    at or before and the first one after are running values; no pairs are made.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in reports.columns))
    a = reports.select(F.col(on).alias("_k"), F.col(report_date).alias("_d"), F.lit(None).cast("date").alias("_m"), row.alias("_row"))
    b = marks.select(F.col(on).alias("_k"), F.col(mark_date).alias("_d"), F.col(mark_date).alias("_m")).where("_d IS NOT NULL").distinct().withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType))
    w = W.partitionBy("_k").orderBy("_d")
    before = F.max("_m").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min("_m").over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    seen = a.unionByName(b).select("_row", F.datediff("_d", before).alias("_lag"), F.datediff("_d", after).alias("_lead")).where("_row IS NOT NULL")
    lag = F.when(F.col("_lag") <= most, F.col("_lag"))
    lead = F.when(F.col("_lead") >= -most, F.col("_lead"))
    gap = F.when(lead.isNull() | (lag <= -lead), lag).otherwise(lead)
    return seen.select("_row.*", gap.alias("gap"))


def lead_lag_tally(df: DataFrame, key: str, strict: Column, gap: str = "gap") -> DataFrame:
    """(key, reports, strict, leads, lags, same, median_lag, alone) over the reports for which strict holds.

    median_lag: of the sorted lags the one at index lags // 2, exact; from counts by gap, of which a key has no more than the window has days.
    """
    held = F.coalesce(strict, F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.col(gap).alias("gap"), held.alias("strict"))
    per = rows.groupBy("key").agg(
        F.count("*").alias("reports"),
        F.count_if("strict").alias("strict"),
        F.count_if(F.col("strict") & (F.col("gap") < 0)).alias("leads"),
        F.count_if(F.col("strict") & (F.col("gap") > 0)).alias("lags"),
        F.count_if(F.col("strict") & (F.col("gap") == 0)).alias("same"),
        F.count_if(F.col("strict") & F.col("gap").isNull()).alias("alone"),
    )
    lags = rows.where("strict AND gap > 0").groupBy("key", "gap").agg(F.count("*").alias("n"))
    w = W.partitionBy("key").orderBy("gap")
    upto = lags.select("key", "gap", F.sum("n").over(w).alias("upto"), F.sum("n").over(W.partitionBy("key")).alias("all"))
    median = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("key").agg(F.min("gap").alias("median_lag"))
    return per.join(median, "key", "left").select(F.col("key").alias(key), "reports", "strict", "leads", "lags", "same", "median_lag", "alone")


def subset_profiles(df: DataFrame, subsets: Mapping[str, Column], dims: Sequence[str], floor: int = 20) -> DataFrame:
    """(subset, dim, value, n, of, share, base_share, lift): how each subset divides by each dimension, against all rows.

    subsets: name to condition; a row may be in several or none. share is n of the subset's rows, base_share that of all rows; lift is null where the subset has
    fewer than floor rows. Null values are a value. One pass: a row is counted once a dimension, with a count a subset, and combined before the shuffle.
    """
    names = list(subsets)
    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(f"s{k}") for k, c in enumerate(subsets.values())]
    rows = df.select(*flags, F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))))
    cols = [f"s{k}" for k in range(len(names))]
    per = rows.groupBy("dim", "value").agg(F.count("*").alias("all"), *(F.sum(c).alias(c) for c in cols))
    total = per.groupBy("dim").agg(F.sum("all").alias("t_all"), *(F.sum(c).alias(f"t_{c}") for c in cols))
    both = per.join(F.broadcast(total), "dim")  # a row a dimension
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("subset"), F.col(c).alias("n"), F.col(f"t_{c}").alias("of")) for n, c in zip(names, cols, strict=True))))
    out = both.select("dim", "value", (F.col("all") / F.col("t_all")).alias("base_share"), each).where("n > 0")
    share = F.col("n") / F.col("of")
    return out.select("subset", "dim", "value", "n", "of", share.alias("share"), "base_share", F.when(F.col("of") >= floor, share / F.col("base_share")).alias("lift"))


def subset_measures(df: DataFrame, subsets: Mapping[str, Column], measures: Mapping[str, tuple[Column, Column]], medians: Mapping[str, Column], floor: int = 20) -> DataFrame:
    """(subset, n, a rate and its base for each measure, a median for each of medians): all rows as subset "all", and each subset.

    A measure (test, base) is the share of rows with test among those with base; null below floor rows of base. Of n values that are not null a
    median is the one at index n // 2, from counts by value, which are combined before the shuffle: meant for days, counts and other whole numbers.
    """
    held = {"all": F.lit(True), **subsets}
    which = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in held.items())), lambda x: x.isNotNull())
    yes = lambda c: F.coalesce(c, F.lit(False))
    cols = {f"b_{n}": yes(b) for n, (_, b) in measures.items()} | {f"t_{n}": yes(b) & yes(t) for n, (t, b) in measures.items()} | {f"m_{n}": c.cast("double") for n, c in medians.items()}
    rows = df.select(F.explode(which).alias("subset"), *(c.alias(n) for n, c in cols.items()))
    out = rows.groupBy("subset").agg(
        F.count("*").alias("n"),
        *(F.count_if(f"b_{n}").alias(f"{n}_base") for n in measures),
        *(F.count_if(f"t_{n}").alias(f"{n}_hits") for n in measures),
    )
    if medians:
        each = rows.select("subset", F.inline(F.array(*(F.struct(F.lit(n).alias("median"), F.col(f"m_{n}").alias("v")) for n in medians)))).where("v IS NOT NULL")
        w = W.partitionBy("subset", "median")
        upto = each.groupBy("subset", "median", "v").agg(F.count("*").alias("c")).select("*", F.sum("c").over(w.orderBy("v")).alias("upto"), F.sum("c").over(w).alias("all"))
        middle = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("subset").agg(*(F.min(F.when(F.col("median") == n, F.col("v"))).alias(n) for n in medians))
        out = out.join(middle, "subset", "left")
    rates = {n: F.when(F.col(f"{n}_base") >= floor, F.col(f"{n}_hits") / F.col(f"{n}_base")) for n in measures}
    return out.select("subset", "n", *(f"{n}_base" for n in measures), *(r.alias(n) for n, r in rates.items()), *medians)
