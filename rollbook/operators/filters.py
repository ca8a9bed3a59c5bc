"""Selections: a filter state compiled to one predicate, and facet counts under it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import UNKNOWN, facet_value


@dataclass(frozen=True)
class Range:
    """Inclusive bounds. Rows without a value pass, unless the range is one of dates that narrows the data's own."""

    low: object
    high: object
    narrowed_dates: bool = False


@dataclass(frozen=True)
class FilterState:
    """search: in any column. contains: by column, all of them. ranges and facets: by column, all of them; a facet's values are alternatives."""

    search: str = ""
    contains: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, Range] = field(default_factory=dict)
    facets: Mapping[str, Sequence[str]] = field(default_factory=dict)


def search_any(columns: Sequence[str], term: str) -> Column:
    """Whether any column holds the term, whatever the case."""
    return F.lower(F.concat_ws("\u0001", *(F.col(c).cast("string") for c in columns))).contains(term.lower())


def in_range(column: str, r: Range) -> Column:
    inside = F.col(column).between(F.lit(r.low), F.lit(r.high))
    return F.coalesce(inside, F.lit(False)) if r.narrowed_dates else F.coalesce(inside, F.lit(True))


def without_facets(df: DataFrame, state: FilterState) -> Column:
    """The predicate of all parts but the facets."""
    out = F.lit(True)
    if state.search:
        out &= search_any(df.columns, state.search)
    for c, text in state.contains.items():
        if text:
            out &= F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    for c, r in state.ranges.items():
        out &= in_range(c, r)
    return out


def facet_fails(state: FilterState) -> dict[str, Column]:
    """By facet with ticked values: 1 where the row fails it."""
    return {c: (~facet_value(F.col(c)).isin(*values)).cast("int") for c, values in state.facets.items() if values}


def select(df: DataFrame, state: FilterState) -> DataFrame:
    """The rows that pass the whole state."""
    out = without_facets(df, state)
    for fail in facet_fails(state).values():
        out &= fail == 0
    return df.where(out)


def facet_counts(df: DataFrame, state: FilterState, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n): for each facet the counts under all other filters, its own left out. One scan, one aggregation.

    A row counts for a facet if it fails no other: it fails none, or that one alone.
    """
    fails = facet_fails(state)
    total = sum(fails.values(), F.lit(0))
    rows = df.where(without_facets(df, state)).select(*(facet_value(F.col(c)).alias(c) for c in facets), total.alias("_fails"), *(f.alias(f"_fail_{c}") for c, f in fails.items()))
    own = lambda c: F.col(f"_fail_{c}") if c in fails else F.lit(0)
    cells = F.array(*(F.when(F.col("_fails") == own(c), F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"))) for c in facets))
    return rows.select(F.explode(F.array_compact(cells)).alias("cell")).groupBy("cell.facet", "cell.value").agg(F.count("*").alias("n"))


def facet_options(counts: DataFrame, state: FilterState, top: int = 10) -> DataFrame:
    """(facet, value, n, ticked): the options of a facet list: ticked values first (also those with no row), then by count, the
    first top of them, and the unknown bucket always."""
    from pyspark.sql import Window as W

    spark = counts.sparkSession
    ticked = spark.createDataFrame([(c, v) for c, vs in state.facets.items() for v in vs] or [("", "")], "facet string, value string").where("facet <> ''")
    rows = counts.join(F.broadcast(ticked.withColumn("ticked", F.lit(True))), ["facet", "value"], "full").fillna({"n": 0, "ticked": False})
    order = W.partitionBy("facet").orderBy(F.desc("ticked"), F.desc("n"), "value")
    return rows.withColumn("k", F.row_number().over(order)).where((F.col("k") <= top) | (F.col("value") == UNKNOWN) | F.col("ticked")).drop("k")
