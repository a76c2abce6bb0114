"""Readers and writers: raw CSV in, cleaned tables and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.schema import LABEL_SCHEMA, LISTING_SCHEMA, MISSING_TOKENS, RAW_SCHEMA
from venuegrid.sources import folders
from venuegrid.sources.records import parsed, records


def load_raw(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The source CSV, all columns as text, missing tokens as null.

    Columns are found by the names in the header, whatever their order; a missing
    one raises, further ones follow the known ones. Files with another header than
    the first, and records with too few or too many fields, raise when they are
    read. ``multi_line=False`` lets tasks share a file that is known to hold no line
    breaks inside quotes. A byte-order mark is skipped.
    """
    if not folders.exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line)
    header = _header(reader.csv(path).columns, path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return _known_first(reader.options(enforceSchema=False, mode="FAILFAST").schema(text).csv(path))


def load_raw_shared(spark: SparkSession, path: str) -> DataFrame:
    """As ``load_raw`` with line breaks inside quotes, but the tasks share large files.

    The text is written once to the work folder, by block. Files are UTF-8, and a
    quote that is not doubled stands only at the ends of a field; a file that ends
    inside quotes raises. ``load_raw`` reads each file in one task instead.
    """
    if not folders.exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    header = _header(spark.read.options(header=True, escape='"', multiLine=True).csv(path).columns, path)
    return _known_first(parsed(records(spark, path), header))


def _header(header: list[str], path: str) -> list[str]:
    missing = [c for c in RAW_SCHEMA.names if c not in header]
    if missing:
        raise ValueError(f"Columns missing in {path}: {missing}")
    return header


def _known_first(rows: DataFrame) -> DataFrame:
    """Known columns, then further ones; missing tokens as null."""
    order = [*RAW_SCHEMA.names, *[c for c in rows.columns if c not in RAW_SCHEMA.names]]
    return rows.select(*[F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in order])


def load_processed(spark: SparkSession, path: str, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """A table written by ``write_table``; the schema is known, so nothing is inferred."""
    if not folders.exists(spark, path):
        raise FileNotFoundError(f"Processed data not found: {path}. Run the cleaning job first.")
    return spark.read.schema(schema).parquet(path)


def load_processed_csv(spark: SparkSession, path: str, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """The CSV form of a processed table, line breaks inside quotes included; an empty field is missing."""
    if not folders.exists(spark, path):
        raise FileNotFoundError(f"Processed data not found: {path}. Run the cleaning job first.")
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", "")
    reader = reader.option("multiLine", True)
    return reader.csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path, compression=folders.COMPRESSION)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; ``single_file`` is for result tables of a few lines."""
    out = df.coalesce(1) if single_file else df
    keep_space = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").options(header=True, escape='"', **keep_space).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def register_views(listings: DataFrame, labels: DataFrame) -> None:
    """Expose both tables to SQL under fixed names and types."""
    def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])

    typed(listings, LISTING_SCHEMA).createOrReplaceTempView("restaurants")
    typed(labels, LABEL_SCHEMA).createOrReplaceTempView("restaurant_cuisines")
