"""Where the terms of a lexicon stand in texts, and which of overlapping mentions hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def term_spans(df: DataFrame, key: str, text: str, lexicon: Mapping[str, str]) -> DataFrame:
    """(key, label, place, start, end, term): every match of each pattern; start and end count characters from 0, place is that of the label in the lexicon.

    The key tells the rows apart. Patterns match one character at least; a pattern's own matches don't overlap. Null or empty text: no
    row. What stands between the matches and the matches themselves add up to the positions, in one window on the key; the
    text stays where it is, only matches and lengths are shuffled.
    """
    size = lambda a: F.transform(a, lambda s: F.length(s).cast("long"))
    each = [
        F.struct(F.lit(n).alias("label"), F.lit(k).alias("place"), size(F.split(F.col(text), p)).alias("gaps"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("terms"))
        for k, (n, p) in enumerate(lexicon.items())
    ]
    rows = df.select(key, F.inline(F.array(*each))).where(F.size("terms") > 0)
    rows = rows.select(key, "label", "place", F.posexplode(F.arrays_zip("terms", F.expr("slice(gaps, 1, size(terms))").alias("gaps"))).alias("k", "m"))
    rows = rows.select(key, "label", "place", "k", F.col("m.terms").alias("term"), F.col("m.gaps").alias("gap"), F.length("m.terms").alias("size")).repartition(key)
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy(key, "label").orderBy("k"))
    return rows.withColumn("end", end).select(key, "label", "place", (F.col("end") - F.col("size")).alias("start"), "end", "term")


def longest_mentions(spans: DataFrame, key: str) -> DataFrame:
    """Of the spans of a key that overlap the longest stays, of equally long ones the first, then that of the earlier label. Columns as in term_spans.

    Spans are first parted into runs that touch each other, by a running maximum of the ends; the choice is folded inside a run, over
    its spans from the longest, so that a text of many mentions costs its runs and not their square. Repeated spans stay once.
    """
    w = W.partitionBy(key).orderBy("start", "end", "place")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    runs = spans.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    span = F.struct((F.col("start") - F.col("end")).alias("shorter"), "start", "place", "end", "label", "term")
    kind = "array<struct<shorter: bigint, start: bigint, place: int, end: bigint, label: string, term: string>>"
    found = runs.groupBy(key, "_run").agg(F.sort_array(F.collect_list(span)).cast(kind).alias("found"))
    meets = lambda acc, s: F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"]))
    kept = F.aggregate("found", F.array().cast(kind), lambda acc, s: F.when(meets(acc, s), acc).otherwise(F.array_append(acc, s)))
    return found.select(key, F.inline(kept)).select(key, "label", "place", "start", "end", "term")
