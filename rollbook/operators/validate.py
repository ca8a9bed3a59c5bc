"""Checks of tables: identities, sums against printed totals, tolerances, duplicate keys, agreement, verdict guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken_identity(df: DataFrame, whole: Column, parts: Column) -> DataFrame:
    """Rows whose whole is not the sum of its parts; rows with a null in either are not judged."""
    return df.where(whole != parts)


def against_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], value: str, total: str, tolerance: DataFrame | None = None) -> DataFrame:
    """(keys, found, printed, difference): sums that differ from the printed total by more than the tolerance of their key (0 without one).

    Keys that only one side has come with a null on the other.
    """
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("found"))
    out = sums.join(totals.select(*keys, F.col(total).alias("printed")), list(keys), "full")
    if tolerance is not None:
        out = out.join(tolerance.select(*keys, "tolerance"), list(keys), "left")
    else:
        out = out.withColumn("tolerance", F.lit(0))
    difference = F.col("found") - F.col("printed")
    bad = F.coalesce(F.abs(difference) > F.coalesce("tolerance", F.lit(0)), F.lit(True))
    return out.withColumn("difference", difference).where(bad).select(*keys, "found", "printed", "difference")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def agreement(df: DataFrame, ours: Column, theirs: Column, group: str) -> DataFrame:
    """(value, both, only_ours, only_theirs, neither) of two tests by group."""
    a, b = F.coalesce(ours, F.lit(False)), F.coalesce(theirs, F.lit(False))
    return df.groupBy(F.col(group).alias("value")).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_ours"), F.count_if(~a & b).alias("only_theirs"), F.count_if(~a & ~b).alias("neither")
    )


def conflicts(df: DataFrame, key: str, target: str) -> DataFrame:
    """Keys with several targets, or with none."""
    out = df.groupBy(key).agg(F.countDistinct(target).alias("targets"))
    return out.where("targets <> 1")


def all_decided(values: DataFrame, decisions: DataFrame, value: str, target: str) -> DataFrame:
    """values with the target that was decided for each value. A value that has no decision, or several different ones, stops the query, and the error names it.

    Null and empty values need none: their target is null. Decisions are made unique first, so no row of values is doubled.
    """
    one = decisions.groupBy(value).agg(F.min(target).alias(target), F.count_distinct(target).alias("_targets"))
    said = F.concat(F.lit("no single decision for "), F.col(value).cast("string"))
    blank = F.col(value).isNull() | (F.trim(F.col(value).cast("string")) == "")
    settled = F.when(blank, F.lit(None)).when(F.col("_targets") == 1, F.col(target)).otherwise(F.raise_error(said).cast(one.schema[target].dataType))
    return values.join(one, value, "left").select(*(F.col(f"`{c}`") for c in values.columns), settled.alias(target))


def diff(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, was, now, verdict): cells that differ between two tables, and rows that one of them lacks."""
    a = left.select(key, *(F.col(c).cast("string").alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    b = right.select(key, *(F.col(c).cast("string").alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("was"), F.col(f"b_{c}").alias("now")) for c in columns)))
    both = a.join(b, key, "full").select(key, "in_a", "in_b", cells.alias("c")).select(key, "in_a", "in_b", "c.*")
    verdict = F.when(F.col("in_b").isNull(), "gone").when(F.col("in_a").isNull(), "new").when(F.col("was").isNull(), "filled").when(F.col("now").isNull(), "cleared").otherwise("changed")
    return both.withColumn("verdict", verdict).where(~F.col("was").eqNullSafe(F.col("now"))).select(key, "column", "was", "now", "verdict")
