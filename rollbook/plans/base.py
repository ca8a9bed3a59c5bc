"""Tables by their role: the ledger is orders with customers, the intervals run from order to shipment, events are the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' columns."""
    return orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as intervals from the order to the shipment."""
    items = table(spark, sf_dir, "lineitem").withColumn("shipped", F.col("l_shipdate").cast("date"))
    return items.join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
