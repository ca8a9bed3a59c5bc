"""XML in files and in columns: records by a row tag, malformed ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

BROKEN = "_broken"


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records of XML files, a row for each element of row_tag, and apart from them the text of those that can't be read (record).

    Attributes are columns with _ before their name, the text of an element with attributes is _VALUE. Prefixes of namespaces are left out, in row_tag
    too. Give attributes as strings and make numbers of them afterwards (ledger.typed): the reader stops at one that is no number.
    What follows a broken record in its file may be taken for a part of it.
    """
    reader = spark.read.format("xml").schema(f"{schema}, {BROKEN} string")
    # Parsed once, for both.
    rows = checkpointed(reader.options(rowTag=row_tag, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, ignoreNamespace="true").load(path))
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN), rows.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("record"))


def from_xml_column(c: Column, schema: str) -> Column:
    """An XML text as a struct of the schema (with the field _broken for a text that can't be read)."""
    return F.from_xml(c, f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "ignoreNamespace": "true"})


def search_records(df: DataFrame, key: str, xml: str, record: str) -> DataFrame:
    """(key, total, place, record's fields) for each record of a search response <...><numberOfRecords/><records><record>...; place counts from 0.

    record: the schema of one record. A response without records, or one that can't be read, has one row with null fields and place null; total is null for the latter.
    """
    shape = f"numberOfRecords bigint, records struct<record: array<struct<{record}>>>"
    rows = df.select(key, from_xml_column(F.col(xml), shape).alias("r"))
    return rows.select(key, F.col("r.numberOfRecords").alias("total"), F.posexplode_outer("r.records.record").alias("place", "record")).select(key, "total", "place", "record.*")
