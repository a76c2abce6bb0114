"""Every operator as a named query over the test tables: name -> (spark, folder) -> DataFrame.

Thresholds that would keep every group of these tables are raised so that they
discriminate. Rounding is only for values that pass through variances,
trigonometry or plain double sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuegrid.operators import (
    cleaning, features, geo, labels, market, pricing, quality, ratings, report, rollup, scoring, services, slicing, statistics,
)
from venuegrid.plans import buckets, publish
from venuegrid.schema import LABEL_SCHEMA, LISTING_SCHEMA, SERVICE_FLAGS
from venuegrid.session import scratch, settle, work_path
from venuegrid.sources import files
from verification import bindings as b
from verification.oracle import MEAN_DIGITS, RATING_MEANS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PLACE_RADIUS_M = 8_000
#: what tells the lines of each report table apart
REPORT_KEYS = {
    "correlation_tests": ["currency", "variable_x", "variable_y"], "group_comparison_tests": ["variable"],
    "cuisine_opportunities": ["currency", "cuisine"], "high_votes_low_ratings": ["restaurant_id"],
}
FEATURES = [f.name for f in LISTING_SCHEMA][21:]


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def on_listings(name: str, operator: Callable[..., DataFrame], **parameters) -> None:
    _QUERIES[name] = lambda spark, sf: operator(b.listing_tables(spark, sf).listings, **parameters)


def on_labels(name: str, operator: Callable[..., DataFrame], **parameters) -> None:
    _QUERIES[name] = lambda spark, sf: operator(b.listing_tables(spark, sf).labels, **parameters)


def on_both(name: str, operator: Callable[..., DataFrame], **parameters) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tables = b.listing_tables(spark, sf)
        return operator(tables.listings, tables.labels, **parameters)
    _QUERIES[name] = run


def rounded(operator: Callable[..., DataFrame], digits: int, *columns: str) -> Callable[..., DataFrame]:
    def run(*args, **parameters) -> DataFrame:
        return operator(*args, **parameters).withColumns({c: F.round(c, digits) for c in columns})
    return run


def listed(operator: Callable[..., DataFrame], column: str) -> Callable[..., DataFrame]:
    """Array column as one text, which every engine compares the same way."""
    def run(*args, **parameters) -> DataFrame:
        return operator(*args, **parameters).withColumn(column, F.array_join(column, ", "))
    return run


def queries() -> dict[str, Query]:
    return {name: _compared(run) for name, run in _QUERIES.items()}


def _compared(run: Query) -> Query:
    """Means of ratings, and what is computed from them, to the digits that are compared; all else as the operator gives it."""
    def rounded_means(spark: SparkSession, sf: str) -> DataFrame:
        frame = run(spark, sf)
        means = {c: F.round(c, MEAN_DIGITS) for c in RATING_MEANS if c in frame.columns}
        return frame.withColumns(means) if means else frame
    return rounded_means


# ---- sources and sinks -------------------------------------------------------

def _raw_csv(spark: SparkSession, sf: str) -> str:
    path = work_path(spark, "raw-csv")
    files.write_csv(b.raw_listings(spark, sf), path)
    return path


@query
def load_raw(spark, sf):
    return cleaning.snake_case_columns(files.load_raw(spark, _raw_csv(spark, sf)))


@query
def load_raw_shared(spark, sf):
    return cleaning.snake_case_columns(files.load_raw_shared(spark, _raw_csv(spark, sf)))


@query
def load_processed(spark, sf):
    path = work_path(spark, "processed")
    files.write_table(b.listing_tables(spark, sf).listings, path)
    return files.load_processed(spark, path)


@query
def write_clean(spark, sf):
    path = work_path(spark, "clean-csv")
    files.write_csv(cleaning.clean(b.raw_listings(spark, sf)), path)
    return files.load_processed_csv(spark, path, LISTING_SCHEMA)


@query
def write_labels(spark, sf):
    path = work_path(spark, "labels")
    rows = features.explode_labels(cleaning.standardise(b.raw_listings(spark, sf)))
    files.write_table(rows, path, partition_by=["currency"])
    return files.load_processed(spark, path, LABEL_SCHEMA).select(*LABEL_SCHEMA.names)


@query
def write_quality_report(spark, sf):
    path = work_path(spark, "quality-report")
    with scratch(spark):
        lines = report.quality_report(settle(b.raw_listings(spark, sf), "raw"))
        files.write_json(lines, path)
    return spark.read.schema(lines.schema).json(path)


@query
def write_report_tables(spark, sf):
    """Every cell of the four files; test figures with six digits behind the point, other numbers with nine."""
    paths = publish.write_report_tables(b.listing_tables(spark, sf), work_path(spark, "reports"))
    read = spark.read.option("header", True).option("escape", '"')
    return b.union_all(*[_cells_of(read.csv(path), name, REPORT_KEYS[name]) for name, path in paths.items()])


def _cells_of(table: DataFrame, name: str, keys: list[str]) -> DataFrame:
    rows = table.select(F.concat_ws("|", *keys).alias("line"), *[F.col(c) for c in table.columns if c not in keys])
    cells = rows.unpivot(["line"], rows.columns[1:], "column_name", "value").where("value is not null")
    number = F.col("value").try_cast("double")
    shown = F.when(F.col("column_name").isin("statistic", "p_value"), F.round(number, 6)).otherwise(F.round(number, 9))
    return cells.select(
        F.lit(name).alias("table_name"), "line", "column_name", shown.alias("number"), F.when(number.isNull(), F.col("value")).alias("content"),
    )


@query
def write_chart_tables(spark, sf):
    path = publish.write_chart_tables(b.listing_tables(spark, sf), work_path(spark, "charts"), city_least=607)
    digits = F.when(F.col("chart") == "cost_by_city_currency", F.round("y", 5)).otherwise(F.round("y", 9))  # sums of doubles differ in the last ones
    return spark.read.parquet(path).select("chart", "label", "series", F.round("x", 9).alias("x"), digits.alias("y"), "z", "restaurants")


@query
def register_views(spark, sf):
    tables = b.listing_tables(spark, sf)
    files.register_views(tables.listings, tables.labels)
    return spark.sql("""
        SELECT r.currency, COUNT(DISTINCT r.restaurant_id) AS restaurants, COUNT(*) AS cuisine_rows
        FROM restaurant_cuisines AS c JOIN restaurants AS r USING (restaurant_id)
        GROUP BY r.currency
    """)


@query
def ensure_materialised(spark, sf):
    out = work_path(spark, "materialised")
    built = publish.ensure_materialised(spark, out, lambda: cleaning.clean(b.raw_listings(spark, sf)))
    again = publish.ensure_materialised(spark, out, lambda: built.listings.limit(0))
    return b.union_all(
        again.listings.agg(F.count("*").alias("row_count")).select(F.lit("listings").alias("table_name"), "row_count"),
        again.labels.agg(F.count("*").alias("row_count")).select(F.lit("labels").alias("table_name"), "row_count"),
    )


# ---- cleaning ----------------------------------------------------------------

def _text(spark, sf) -> DataFrame:
    return cleaning.snake_case_columns(b.raw_listings(spark, sf))


@query
def snake_case_columns(spark, sf):
    return _text(spark, sf)


@query
def trim_blank_to_null(spark, sf):
    return cleaning.trim_blank_to_null(_text(spark, sf))


@query
def normalise_flags(spark, sf):
    return cleaning.normalise_flags(_text(spark, sf)).select("restaurant_id", *SERVICE_FLAGS)


_NUMBERS = ["longitude", "latitude", "average_cost_for_two", "price_range", "aggregate_rating", "votes"]


@query
def coerce_numeric(spark, sf):
    return cleaning.coerce_numeric(_text(spark, sf)).select("restaurant_id", "country_code", *_NUMBERS)


@query
def null_out_of_domain(spark, sf):
    rows = cleaning.null_out_of_domain(cleaning.coerce_numeric(_text(spark, sf)))
    return rows.select("restaurant_id", "aggregate_rating", "price_range", "votes", "average_cost_for_two")


@query
def null_bad_coordinates(spark, sf):
    rows = cleaning.null_bad_coordinates(cleaning.coerce_numeric(_text(spark, sf)))
    return rows.select("restaurant_id", "longitude", "latitude")


@query
def clean(spark, sf):
    return cleaning.clean(b.raw_listings(spark, sf))


@query
def clean_and_write(spark, sf):
    tables, lines = publish.clean_and_write(spark, _raw_csv(spark, sf), work_path(spark, "published"))
    counted = tables.listings.agg(
        F.count("*").alias("listing_rows"), F.sum("cuisine_count").alias("label_tokens"),
        F.count("aggregate_rating").alias("ratings"),
    )
    return counted.withColumns({
        "label_rows": tables.labels.agg(F.count("*")).scalar(),
        "reported_rows": lines.where("subject = 'rows' and section = 'counter'").select("amount").scalar(),
    })


# ---- features ----------------------------------------------------------------

def _feature(name: str, step: Callable[[DataFrame], DataFrame], *columns: str) -> None:
    """One feature step on the typed listings, without the stored tables."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return step(b.market(spark, sf)).select("restaurant_id", *columns)
    _QUERIES[name] = run


_feature("label_count", features.with_label_count, "cuisine_count")
_feature("rating_flags", features.with_rating_flags, "is_rated", "is_high_rated", "is_low_rated")
_feature("price_flags", features.with_price_flags, "is_affordable", "is_expensive")
_feature("any_flag", features.with_service_flags, "has_digital_service", "has_booking_or_delivery")
_feature("rating_category", features.with_rating_category, "rating_category")
_feature("vote_category", features.with_vote_category, "vote_category")
_feature("cost_category", features.with_cost_category, "cost_category")
on_listings("explode_labels", features.explode_labels)
on_listings("cost_percentile", features.cost_percentile)


@query
def relabel_flag(spark, sf):
    rows = features.relabel_flag(b.listing_tables(spark, sf).listings)
    return rows.select("restaurant_id", "digital_services", "aggregate_rating")


# ---- quality -----------------------------------------------------------------

on_listings("profile_shape", quality.profile_shape)
on_listings("missing_by_column", quality.missing_by_column)
on_listings("domain_violations_clean", quality.domain_violations)
on_listings("iqr_report", quality.iqr_report)
on_listings("code_currency_map", listed(quality.code_currency_map, "currencies"))
on_listings("flag_domains", listed(quality.flag_domains, "flag_values"))
on_listings("value_counts", quality.value_counts)
on_listings("flag_value_counts", quality.flag_value_counts)
on_listings("column_profile", quality.column_profile)
on_listings("top_values", quality.top_values)
on_listings("describe_percentiles", rounded(
    quality.describe_percentiles, 6, "mean_value", "std_value", "p1", "p25", "p50", "p75", "p95", "p99"
))
on_listings("post_clean_counters", quality.post_clean_counters)
on_both("constraint_checks", quality.constraint_checks)


@query
def exact_duplicate_rows(spark, sf):
    return quality.exact_duplicate_rows(b.document_rows(spark, sf))


@query
def id_uniqueness(spark, sf):
    return quality.id_uniqueness(b.order_lines(spark, sf))


@query
def duplicate_id_groups(spark, sf):
    return quality.duplicate_id_groups(b.order_lines(spark, sf))


def _numeric(spark, sf) -> DataFrame:
    return cleaning.coerce_numeric(_text(spark, sf))


@query
def invalid_coordinates(spark, sf):
    return quality.invalid_coordinates(_numeric(spark, sf))


@query
def zero_coordinate_pairs(spark, sf):
    return quality.zero_coordinate_pairs(_numeric(spark, sf))


@query
def domain_violations(spark, sf):
    return quality.domain_violations(_numeric(spark, sf))


@query
def iqr_fences_by_group(spark, sf):
    return quality.iqr_fences_by_group(b.event_values(spark, sf))


@query
def zero_rating_text_mismatch(spark, sf):
    return quality.zero_rating_text_mismatch(_text(spark, sf))


@query
def cost_outliers(spark, sf):
    return quality.cost_outliers(b.event_values(spark, sf), carried=["restaurant_id"])


@query
def quality_contract(spark, sf):
    raw = settle(b.raw_listings(spark, sf), "raw")
    return quality.quality_contract(raw, cleaning.standardise(raw))


# ---- market ------------------------------------------------------------------

on_listings("market_summary", market.market_summary)
on_listings("scope_totals", market.scope_totals)
on_listings("country_counts", market.country_counts)
on_listings("city_counts_topk", market.city_counts_topk, k=15)
on_listings("price_band_share", market.price_band_share)
on_listings("price_band_counts", market.price_band_counts)
on_listings("rating_category_counts", market.rating_category_counts)
on_listings("city_rank", market.city_rank)
on_listings("city_screen", market.city_screen, minimum=607)
on_listings("city_coverage", market.city_coverage)
on_listings("city_coverage_fewest_votes", market.city_coverage, fewest_votes_first=True)
on_listings("city_rating_topk", market.city_rating_topk, minimum=590)
on_listings("city_currency_location", market.city_currency_location)
on_listings("city_currency_topk", market.city_currency_topk)

# ---- ratings -----------------------------------------------------------------

on_listings("overall_rating", ratings.overall_rating)
on_listings("top_rated", ratings.top_rated)
on_listings("top_voted", ratings.top_voted)
on_listings("rating_by_price", ratings.rating_by_price)
on_listings("rating_by_price_mean", ratings.rating_by_price_mean)
on_listings("rating_by_delivery", ratings.rating_by_delivery)
on_listings("rating_by_booking", ratings.rating_by_booking)
on_listings("high_votes_low_ratings", ratings.high_votes_low_ratings)
on_listings("high_rating_low_votes", ratings.high_rating_low_votes, floor=2.5)
on_listings("votes_rating_points", ratings.votes_rating_points)
on_listings("rating_box_stats", rounded(ratings.rating_box_stats, 9, "q1", "median", "q3"))
on_listings("rating_histogram", ratings.rating_histogram)

# ---- pricing -----------------------------------------------------------------

on_listings("city_currency_cost", pricing.city_currency_cost, minimum=117)
on_listings("city_cost_panels", pricing.city_cost_panels, minimum=117, currencies=3)
on_listings("city_cost_topk", pricing.city_cost_topk)
on_listings("currency_price_band", pricing.currency_price_band)
on_listings("value_picks", pricing.value_picks)
on_listings("premium_picks", pricing.premium_picks)
on_listings("cost_rating_observations", pricing.cost_rating_observations)
on_labels("label_currency_cost", pricing.label_currency_cost, minimum=178)
on_listings("single_currency_mean", pricing.single_currency_mean)


@query
def single_currency_mean_slice(spark, sf):
    rows = slicing.slice_listings(b.listing_tables(spark, sf).listings, currencies=["BUILDING"])
    return pricing.single_currency_mean(rows)


# ---- labels ------------------------------------------------------------------

on_labels("top_labels", labels.top_labels)
on_labels("label_rating", labels.label_rating, minimum=900)
on_labels("label_rating_topk", labels.label_rating_topk, minimum=880)
on_labels("top3_labels_per_city", labels.top3_labels_per_city)
on_listings("distinct_labels", labels.distinct_labels)


@query
def label_currency_join(spark, sf):
    tables = b.listing_tables(spark, sf)
    return labels.label_currency_join(tables.labels, tables.listings, minimum=178, rows=tables.labels.count())


@query
def city_label_pivot(spark, sf):
    tables = b.listing_tables(spark, sf)
    wide = labels.city_label_pivot(tables.listings, tables.labels)
    return wide.unpivot(["city"], [c for c in wide.columns if c != "city"], "cuisine", "restaurants")


# ---- services ----------------------------------------------------------------

on_listings("flag_adoption", services.flag_adoption)
on_listings("adoption_share", services.adoption_share)
on_listings("service_comparison", services.service_comparison)
on_listings("price_service_crosstab", services.price_service_crosstab)

# ---- statistics --------------------------------------------------------------

on_listings("spearman", rounded(rounded(statistics.spearman, 9, "statistic"), 6, "p_value"))
on_listings("welch_t", rounded(statistics.welch_t, 6, "statistic", "p_value"))
on_listings("kruskal", rounded(statistics.kruskal, 6, "statistic", "p_value"))
on_listings("statistical_report", rounded(statistics.statistical_report, 6, "statistic", "p_value"))

# ---- scoring and geography -----------------------------------------------------

on_both("label_opportunities", scoring.label_opportunities, minimum=178)
on_both("label_opportunities_sql", scoring.label_opportunities_sql, minimum=178)


@query
def neighbours_within(spark, sf):
    return geo.neighbours_within(b.places(spark, sf), PLACE_RADIUS_M)


@query
def spatial_clusters(spark, sf):
    return geo.spatial_clusters(b.places(spark, sf), PLACE_RADIUS_M)


@query
def cluster_summary(spark, sf):
    found = geo.cluster_summary(geo.spatial_clusters(b.places(spark, sf), PLACE_RADIUS_M))
    return found.withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


@query
def valid_points(spark, sf):
    return geo.map_points(settle(cleaning.standardise(b.raw_listings(spark, sf)), "standardised"))


# ---- slicing -----------------------------------------------------------------

_SLICE = dict(
    countries=[0, 1, 2], currencies=["BUILDING", "MACHINERY"], cuisines=["small ring", "red widget"],
    prices=[1, 2, 3], rating=(0.5, 4.9), booking="Yes", delivery="No",
)


@query
def slice_listings(spark, sf):
    tables = b.listing_tables(spark, sf)
    return slicing.slice_listings(tables.listings, tables.labels, **_SLICE)


on_listings("slice_listings_default", slicing.slice_listings)


@query
def filter_by_label(spark, sf):
    tables = b.listing_tables(spark, sf)
    return slicing.filter_by_label(tables.listings, tables.labels, ["small ring"]).select("restaurant_id", "cuisines")


@query
def slice_labels(spark, sf):
    tables = b.listing_tables(spark, sf)
    return slicing.slice_labels(tables.labels, slicing.slice_listings(tables.listings, tables.labels, **_SLICE))


on_both("option_lists", slicing.option_lists, countries=[0, 1], currencies=["BUILDING"])


@query
def sliced_city_rank(spark, sf):
    tables = b.listing_tables(spark, sf)
    return market.city_rank(slicing.slice_listings(tables.listings, tables.labels, **_SLICE))


@query
def sliced_label_opportunities(spark, sf):
    tables = b.listing_tables(spark, sf)
    rows = slicing.slice_listings(tables.listings, currencies=["BUILDING", "MACHINERY"], delivery="No")
    return scoring.label_opportunities(rows, slicing.slice_labels(tables.labels, rows), minimum=30)


# ---- roll-ups and bucketed tables ---------------------------------------------

#: the least number of buckets; larger tables get as many as they need
BUCKETS = 8
_CELL_SLICE = {k: v for k, v in _SLICE.items() if k != "cuisines"}


@query
def rollup_summary(spark, sf):
    cells = rollup.write_rollup(b.listing_tables(spark, sf).listings, work_path(spark, "rollup"))
    return rollup.rollup_summary(rollup.slice_rollup(cells, **_CELL_SLICE))


@query
def rollup_counts(spark, sf):
    """Listings under ids that repeat, so that distinct listings are fewer than rows."""
    rows = b.listing_tables(spark, sf).listings.withColumn("restaurant_id", F.floor(F.col("restaurant_id") / 64))
    cells = rollup.write_rollup(rows, work_path(spark, "rollup"))
    return rollup.rollup_counts(rollup.slice_rollup(cells, currencies=["BUILDING", "MACHINERY"], delivery="No"), ["country_code", "city"])


@query
def rollup_option_lists(spark, sf):
    cells = rollup.write_rollup(b.listing_tables(spark, sf).listings, work_path(spark, "rollup"))
    return rollup.rollup_option_lists(cells, countries=[0, 1], currencies=["BUILDING"])


def _bucketed(spark: SparkSession, sf: str) -> publish.Tables:
    tables = b.listing_tables(spark, sf)
    return buckets.write_bucketed(tables, work_path(spark, "buckets"), buckets.buckets_for(tables, BUCKETS))


@query
def bucketed_label_currency_join(spark, sf):
    tables = _bucketed(spark, sf)
    return labels.label_currency_join(tables.labels, tables.listings, minimum=178)


@query
def bucketed_slice_labels(spark, sf):
    tables = _bucketed(spark, sf)
    return slicing.slice_labels(tables.labels, slicing.slice_listings(tables.listings, tables.labels, **_SLICE))
