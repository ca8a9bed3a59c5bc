"""Ledger files: unquoted TSV in and out, JSON documents, optional sources, resume, nested payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: A row with so many cells equal to their column's name is a header inside the data.
HEADER_CELLS = 5


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], seq: str | None = None, comment: str | None = None) -> DataFrame:
    """All columns as strings, quotes taken as they stand, header rows inside the data left out.

    seq: a column of the file that numbers its rows; it comes out as a long, so that the order survives any shuffle.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", enforceSchema=True)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    echo = sum((F.coalesce(F.col(f"`{c}`") == F.lit(c), F.lit(False)).cast("int") for c in columns), F.lit(0))
    df = df.where(echo < min(HEADER_CELLS, len(columns)))
    return df if seq is None else df.withColumn(seq, F.expr(f"try_cast(`{seq}` AS BIGINT)"))


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = (), files: int | None = None) -> None:
    """Unquoted TSV; tabs and line ends in cells become spaces. order sorts the rows over the files; files sets their number."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ").alias(c) for c in df.columns]
    out = df.orderBy(*order) if order else df
    out = out.select(*cells)
    (out.coalesce(files) if files else out).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def read_documents(spark: SparkSession, path: str, schema: str = "id string, date string, pub string, text string") -> DataFrame:
    """One JSON document a line, from a file, folder or glob, with the file it came from."""
    return spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())


def optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The source, or an empty relation of its schema if there is none."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def pending(todo: DataFrame, done: DataFrame, on: Sequence[str], retry: str | None = None) -> DataFrame:
    """The rows of todo without a result; results for which retry holds count as none."""
    kept = done.where(f"NOT ({retry})") if retry else done
    return todo.join(kept.select(*on).distinct(), list(on), "left_anti")


def rename(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Drops, renames and orders columns; two columns of one name are an error."""
    new = [names.get(c, c) for c in df.columns if c not in drop]
    if len(set(new)) != len(new):
        raise ValueError(f"columns collide: {sorted({c for c in new if new.count(c) > 1})}")
    out = df.drop(*drop).withColumnsRenamed(dict(names))
    return out.select(*order, *(c for c in new if c not in order))


def resolve(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """By wanted name the first column that goes by one of its aliases, whatever the case and the spaces around."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    return {name: have[a.strip().lower()] for name, options in aliases.items() for a in options[::-1] if a.strip().lower() in have}


def write_payload(df: DataFrame, path: str) -> None:
    """Each row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def canvases(df: DataFrame, manifest: str, notebook: str) -> DataFrame:
    """(notebook, index, label, page, id): the pages of image manifests, the page number read off the end of the label."""
    shape = "struct<canvases: array<struct<label: string, id: string>>>"
    rows = df.select(notebook, F.posexplode(F.from_json(manifest, shape)["canvases"]).alias("index", "c"))
    page = F.nullif(F.regexp_extract("c.label", r"_([0-9]+)(?:_[^0-9_]*)*$", 1), F.lit("")).cast("int")
    return rows.select(notebook, "index", F.col("c.label").alias("label"), page.alias("page"), F.col("c.id").alias("id"))


def base_view(df: DataFrame, left_out: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """The rows whose cells hold none of the given values, and how many rows each reason takes out (reason, records)."""
    reason = F.lit(None).cast("string")
    for column, values in reversed(list(left_out.items())):
        reason = F.when(F.coalesce(F.col(f"`{column}`").isin(*values), F.lit(False)), F.lit(column)).otherwise(reason)
    told = df.withColumn("_reason", reason)
    dropped = told.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("records"))
    return told.where("_reason IS NULL").drop("_reason"), dropped


def clean_header(df: DataFrame) -> DataFrame:
    """df with its columns' names without a byte order mark, quotes and spaces around; two of one name are an error."""
    names = [c.lstrip("\ufeff").strip().strip('"').strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"columns collide: {sorted({c for c in names if names.count(c) > 1})}")
    return df.toDF(*names)


def typed(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Trimmed cells, empty ones null, rows without any cell left out; the named columns as their types, null where a cell is none."""
    cells = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in df.columns]
    out = df.select(*cells)
    out = out.where(F.coalesce(*(F.col(f"`{c}`") for c in df.columns)).isNotNull())
    return out.select(*(F.expr(f"try_cast(`{c}` AS {kinds[c]})").alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A quoted CSV with a header: all columns as strings, doubled quotes and line ends inside quotes kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, enforceSchema=True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one array or one object: a row for each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_richer(df: DataFrame, path: str, column: str, kind: str = "parquet") -> None:
    """Writes df, but never over a table in which more rows have a value in the column: that is an error.

    df must not read from the path itself."""
    before = optional(df.sparkSession, path, f"`{column}` {dict(df.dtypes)[column]}", kind).where(F.col(column).isNotNull()).count()
    now = df.where(F.col(column).isNotNull()).count()
    if now < before:
        raise ValueError(f"{path} has {before} rows with {column}, the new table only {now}")
    df.write.format(kind).mode("overwrite").save(path)


def export_csv(df: DataFrame, path: str, visible: Sequence[str], order: Sequence[str], decisions: DataFrame | None = None, key: str | None = None) -> None:
    """The visible columns in the order of the screen, with decision columns joined by a key, as quoted CSV."""
    out = df if decisions is None else df.join(decisions, key, "left")
    more = [] if decisions is None else [c for c in decisions.columns if c != key and c not in visible]
    out.orderBy(*order).select(*visible, *more).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
