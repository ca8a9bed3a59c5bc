"""Counts over sliding windows of a stream, with late rows (an extension: the batch operators are in operators.series)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(rows: DataFrame, ts: str, key: str, window: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, end, key, n): rows by key in windows that slide; rows later than the watermark are left out of a stream's state.

    The same plan serves a batch and a stream. Windows are by event time; null times are left out.
    """
    w = F.window(F.col(ts).cast("timestamp"), window, slide)
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
