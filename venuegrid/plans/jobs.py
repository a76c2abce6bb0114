"""Command lines of the jobs."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from venuegrid.plans import publish


def _session(name: str) -> SparkSession:
    """The session that ``spark-submit`` set up; master and resources come from its options."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def clean_listings(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Clean the source into a published build and print what it holds."""
    parser = argparse.ArgumentParser(prog="clean_listings.py", description=clean_listings.__doc__)
    parser.add_argument("raw", help="file or folder of CSV files with a header")
    parser.add_argument("out", help="folder that the builds are published in")
    parser.add_argument("--format", choices=publish.FORMATS, default="parquet", help="of both tables; the report is JSON")
    parser.add_argument("--single-line", action="store_true", help="the source holds no line breaks inside quotes, so tasks may share a file")
    parser.add_argument("--keep", type=int, default=2, help="builds that stay")
    given = parser.parse_args(arguments)
    spark = spark or _session("clean-listings")
    tables, report = publish.clean_and_write(spark, given.raw, given.out, given.format, not given.single_line, given.keep)
    held = {(r["subject"], r["measure"]): r["amount"] for r in report.where("amount is not null and section in ('counter', 'column')").collect()}
    return _print([
        f"Source: {held['rows', 'count']:,} rows; {held['columns', 'count']} columns",
        f"Output: {tables.listings.count():,} listings; {tables.labels.count():,} label rows",
        f"Rows that repeat an id: {held['duplicate_restaurant_ids', 'count']}",
        f"Rows without labels: {held['cuisines', 'missing']}",
    ])


def write_reports(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Write report tables and chart tables from the newest published build."""
    parser = argparse.ArgumentParser(prog="write_reports.py", description=write_reports.__doc__)
    parser.add_argument("tables", help="folder that the builds are published in")
    parser.add_argument("out", help="folder for the report tables")
    given = parser.parse_args(arguments)
    spark = spark or _session("write-reports")
    tables = publish.load_tables(spark, given.tables)
    paths = publish.write_report_tables(tables, given.out)
    charts = publish.write_chart_tables(tables, given.out)
    return _print([*(f"{name}: {path}" for name, path in paths.items()), f"charts: {charts}"])


def _print(lines: list[str]) -> list[str]:
    for line in lines:
        print(line, flush=True)
    return lines
