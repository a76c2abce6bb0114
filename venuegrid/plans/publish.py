"""Jobs: clean and publish the tables once, then write the report tables and chart tables from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from venuegrid.operators.cleaning import clean
from venuegrid.operators.features import explode_labels
from venuegrid.operators.ratings import high_votes_low_ratings
from venuegrid.operators.report import quality_report
from venuegrid.operators.scoring import label_opportunities
from venuegrid.operators.statistics import group_comparisons, spearman
from venuegrid.plans.charts import chart_lines
from venuegrid.schema import LISTING_SCHEMA
from venuegrid.session import scratch, settle
from venuegrid.sources import files, folders, snapshots

FORMATS = snapshots.FORMATS


@dataclass(frozen=True)
class Tables:
    listings: DataFrame
    labels: DataFrame


def _of(spark: SparkSession, seen: snapshots.Snapshot) -> Tables:
    return Tables(seen.table(spark, "listings"), seen.table(spark, "labels"))


def load_tables(spark: SparkSession, out: str) -> Tables:
    """The two tables of the newest published build."""
    seen = snapshots.latest(spark, out)
    if seen is None:
        raise FileNotFoundError(f"Processed data not found: {out}. Run the cleaning job first.")
    return _of(spark, seen)


def load_quality_report(spark: SparkSession, out: str) -> DataFrame:
    """The report that was published with the newest tables."""
    seen = snapshots.latest(spark, out)
    if seen is None or "quality_report" not in seen.tables:
        raise FileNotFoundError(f"Quality report not found: {out}. Run the cleaning job first.")
    return seen.table(spark, "quality_report")


def _draft_tables(draft: snapshots.Draft, listings: DataFrame, form: str) -> None:
    """The listings, then the label rows from what was written."""
    if form not in FORMATS:
        raise ValueError(f"Unknown format {form}; known are {FORMATS}")
    stored = draft.add("listings", listings.select(*LISTING_SCHEMA.names), form)
    draft.add("labels", explode_labels(stored), form)


def write_tables(listings: DataFrame, out: str, form: str = "parquet") -> Tables:
    """Publish the listings and their label rows as one build."""
    draft = snapshots.Draft(listings.sparkSession, out)
    _draft_tables(draft, listings, form)
    return _of(listings.sparkSession, draft.publish())


def ensure_materialised(spark: SparkSession, out: str, build: Callable[[], DataFrame], form: str = "parquet") -> Tables:
    """Load the two tables of the newest build, building both first when there is none.

    A build that broke between its tables was never published, so it is done again.
    """
    seen = snapshots.latest(spark, out)
    if seen is None:
        with scratch(spark):
            return write_tables(build(), out, form)
    return _of(spark, seen)


def clean_and_write(
    spark: SparkSession, raw_path: str, out: str, form: str = "parquet", multi_line: bool = True, keep: int = 2,
) -> tuple[Tables, DataFrame]:
    """Load, profile, clean and explode the source and publish tables and quality report as one build.

    The newest build is returned as it is if it came from the same files, unchanged,
    in the same form. ``keep`` builds stay, so that readers of the one before can finish.
    """
    source = f"{form}:{multi_line}:{folders.stamp(spark, raw_path) if folders.exists(spark, raw_path) else ''}"
    seen = snapshots.latest(spark, out)
    if seen is None or seen.source != source:
        draft = snapshots.Draft(spark, out, source)
        with scratch(spark):
            raw = settle(files.load_raw(spark, raw_path, multi_line), "raw")
            _draft_tables(draft, clean(raw), form)
            draft.add("quality_report", quality_report(raw).coalesce(1), "json")
        seen = draft.publish()
        snapshots.expire(spark, out, keep)
    return _of(spark, seen), seen.table(spark, "quality_report")


def write_report_tables(tables: Tables, out: str) -> dict[str, str]:
    """Correlations, group tests, opportunities, and much-voted low-rated listings."""
    listings, labels = tables.listings, tables.labels
    paths = {name: f"{out}/{name}" for name in ("correlation_tests", "group_comparison_tests", "cuisine_opportunities", "high_votes_low_ratings")}
    with scratch(listings.sparkSession):
        files.write_csv(spearman(listings), paths["correlation_tests"], single_file=True)
        files.write_csv(group_comparisons(listings), paths["group_comparison_tests"], single_file=True)
        files.write_csv(label_opportunities(listings, labels), paths["cuisine_opportunities"], single_file=True)
        # This one is a share of the listings, so it keeps its partitions.
        files.write_csv(high_votes_low_ratings(listings), paths["high_votes_low_ratings"])
    return paths


def write_chart_tables(tables: Tables, out: str, **options) -> str:
    """All charts' lines in one table, a folder for each chart."""
    path = f"{out}/charts"
    with scratch(tables.listings.sparkSession):
        files.write_table(chart_lines(tables.listings, tables.labels, **options), path, partition_by=["chart"])
    return path
