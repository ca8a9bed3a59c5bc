"""Reviewed overlays, ordered inserts, ditto and anchor fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import blank_to_null


def fill_blank(df: DataFrame, overlay: DataFrame, on: str, column: str) -> DataFrame:
    """The overlay's value where the cell is blank."""
    o = overlay.select(on, F.col(column).alias("_o"))
    return df.join(o, on, "left").withColumn(column, F.coalesce(blank_to_null(F.col(column)), F.col("_o"))).drop("_o")


def replace_if(df: DataFrame, overlay: DataFrame, on: str, column: str, condition: Column) -> DataFrame:
    """The overlay's value where there is one and the condition holds; overlay columns are seen as _o_<name>."""
    o = overlay.select(on, *(F.col(c).alias(f"_o_{c}") for c in overlay.columns if c != on))
    value = F.col(f"_o_{column}")
    out = df.join(o, on, "left").withColumn(column, F.when(value.isNotNull() & condition, value).otherwise(F.col(column)))
    return out.select(*df.columns)


def match_or_unique(df: DataFrame, overlay: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """df with the overlay's value for its key: that of an equal date (the least of several), else the only one the key has."""
    exact = overlay.groupBy(key, date).agg(F.min(value).alias("_exact"))
    single = overlay.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias("_only")).where("_n = 1").drop("_n")
    out = df.join(exact, [key, date], "left").join(single, key, "left")
    return out.withColumn(value, F.coalesce("_exact", "_only")).drop("_exact", "_only")


def insert_after(df: DataFrame, new: DataFrame, seq: str, anchor: str, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """df and the rows of new, each after the row whose seq is its anchor, several by order; seq is numbered anew.

    Rows without their anchor are left out; unmatched() lists them. The other columns of new are those of df.
    """
    keys = list(partition)
    rest = [c for c in df.columns if c != seq]
    old = df.select(*rest, F.col(seq).alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_k"))
    has = df.select(*keys, F.col(seq).alias(anchor))
    added = new.join(has, [*keys, anchor], "left_semi").select(*rest, F.col(anchor).alias("_at"), F.lit(1).alias("_side"), F.col(order).cast("long").alias("_k"))
    w = W.partitionBy(*keys).orderBy("_at", "_side", "_k")
    return old.unionByName(added).withColumn(seq, F.row_number().over(w).cast("long")).withColumn("inserted", F.col("_side") == 1).drop("_at", "_side", "_k")


def unmatched(df: DataFrame, new: DataFrame, seq: str, anchor: str, partition: Sequence[str] = ()) -> DataFrame:
    """The rows of new whose anchor df lacks."""
    return new.join(df.select(*partition, F.col(seq).alias(anchor)), [*partition, anchor], "left_anti")


def above(df: DataFrame, partition: Sequence[str], order: Sequence[str], column: str, ditto: Column) -> DataFrame:
    """Ditto cells take the last cell above in their group that is no ditto."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(~ditto, F.col(column)), ignorenulls=True).over(w)
    return df.withColumn(column, F.when(ditto, last).otherwise(F.col(column)))


def between_anchors(df: DataFrame, partition: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Empty cells take the value of the cells before and after them, where these two agree."""
    w = W.partitionBy(*partition).orderBy(*order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(F.col(column), F.when(before == after, before)))


def shift_block_down(df: DataFrame, partition: Sequence[str], order: Sequence[str], columns: Sequence[str], run: Column) -> DataFrame:
    """Within the marked rows each row takes the columns of the row above; the first marked row keeps its own."""
    w = W.partitionBy(*partition).orderBy(*order)
    moved = F.lag(F.struct(*columns)).over(w)
    inside = run & F.coalesce(F.lag(run).over(w), F.lit(False))
    staged = df.withColumns({"_moved": moved, "_inside": inside})
    return staged.withColumns({c: F.when(F.col("_inside"), F.col(f"_moved.{c}")).otherwise(F.col(c)) for c in columns}).drop("_moved", "_inside")
