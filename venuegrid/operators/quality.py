"""Profiling, constraint checks and outlier fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.ranks import LEAF_ROWS, quantiles
from venuegrid.functions.text import to_number
from venuegrid.schema import NOT_RATED_TEXT, PRICE_BANDS, SERVICE_FLAGS


def _long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One (column, value) row per cell, values as text."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column_name", "value")


def _one_row_to_long(row: DataFrame, key: str, value: str) -> DataFrame:
    return row.unpivot([], row.columns, key, value)


def profile_shape(df: DataFrame) -> DataFrame:
    """Row count beside the name, position and type of each column."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(df.schema, 1)
    ])
    counted = df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))
    return counted.withColumn("f", F.explode(fields)).select("row_count", "column_count", "f.*")


def missing_by_column(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _one_row_to_long(counts, "column_name", "missing")


def exact_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; missing equals missing.

    Only a 64-bit digest is shuffled for every row. Full rows are compared just
    for digests that occur more than once, so a digest collision changes nothing.
    """
    digest = F.xxhash64(*[F.col(c) for c in df.columns])
    rows = df.withColumn("_digest", digest)
    repeated = rows.groupBy("_digest").count().where("count > 1").select("_digest")
    copies = rows.join(repeated, "_digest", "left_semi").groupBy(*df.columns).count()
    surplus = F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
    return copies.agg(surplus.alias("exact_duplicate_rows"))


def id_uniqueness(df: DataFrame) -> DataFrame:
    rows, ids = F.count("*"), F.count_distinct("restaurant_id")
    return df.agg(
        rows.alias("restaurant_rows"),
        ids.alias("unique_restaurant_ids"),
        (rows - ids).alias("duplicate_id_rows"),
    )


def duplicate_id_groups(df: DataFrame) -> DataFrame:
    """Number of ids that occur more than once (ids, not rows)."""
    repeated = df.groupBy("restaurant_id").count().where("count > 1")
    return repeated.agg(F.count("*").alias("exact_duplicate_id_rows"))


def bad_coordinate() -> Column:
    """Whether a row's coordinates are missing, out of range or the placeholder."""
    lon, lat = F.col("longitude"), F.col("latitude")
    outside = F.coalesce(~lon.between(-180, 180), F.lit(True)) | F.coalesce(~lat.between(-90, 90), F.lit(True))
    placeholder = F.coalesce((lon == 0) & (lat == 0), F.lit(False))
    return outside | placeholder


def invalid_coordinates(df: DataFrame) -> DataFrame:
    """Profile count (missing, out of range or placeholder) and plain missing count."""
    lon, lat = F.col("longitude"), F.col("latitude")
    return df.agg(
        F.count_if(bad_coordinate()).alias("invalid_coordinate_rows"),
        F.count_if(lon.isNull() | lat.isNull()).alias("missing_coordinates"),
    )


def violations() -> dict[str, Column]:
    """What makes a value out of domain, by the name of its count.

    ``invalid_*`` takes a missing value as invalid; ``out_of_range_*`` does not.
    """
    rating, price = F.col("aggregate_rating"), F.col("price_range")
    votes, cost = F.col("votes"), F.col("average_cost_for_two")
    no_label = F.col("cuisines").isNull() | (F.btrim("cuisines") == "")
    return {
        "missing_cuisine": no_label,
        "zero_cost_rows": cost == 0,
        "negative_cost": cost < 0,
        "unrated_rows": rating == 0,
        "invalid_ratings": F.coalesce(~rating.between(0, 5), F.lit(True)),
        "invalid_price_ranges": F.coalesce(~price.isin(PRICE_BANDS), F.lit(True)),
        "out_of_range_rating": ~rating.between(0, 5),
        "out_of_range_price": ~price.between(1, 4),
        "negative_votes": votes < 0,
    }


def domain_violations(df: DataFrame) -> DataFrame:
    """Counts of out-of-domain values on clean or raw rows."""
    return df.agg(*[F.count_if(wrong).alias(name) for name, wrong in violations().items()])


def fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    spread = q3 - q1
    return q1 - 1.5 * spread, q3 + 1.5 * spread


def iqr_fences_by_group(
    df: DataFrame, group: str = "currency", value: str = "average_cost_for_two", leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Per group, missing group included: positive values, both fences, rows above the upper one."""
    kept = df.where(F.col(value) > 0).select(group, value)
    fenced = quantiles(kept, [group], value, {"q1": 0.25, "q3": 0.75}, leaf_rows)
    lower, upper = fences(F.col("q1"), F.col("q3"))
    fenced = fenced.select(group, lower.alias("iqr_lower_fence"), upper.alias("iqr_upper_fence"))
    keys = ["iqr_lower_fence", "iqr_upper_fence"]
    seen = null_safe_join(kept, fenced, [group]).groupBy(group, *keys).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(value) > F.col("iqr_upper_fence")).alias("flagged_rows"),
    )
    # A group without any positive value still gets its (empty) line.
    groups = df.select(group).distinct()
    return null_safe_join(groups, seen, [group], "left").select(
        group, F.coalesce("row_count", F.lit(0)).alias("row_count"), *keys,
        F.coalesce("flagged_rows", F.lit(0)).alias("flagged_rows"),
    )


def iqr_report(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Two-sided fences and flagged rows for rated ratings and for votes, in one pass."""
    rating = F.when(F.col("aggregate_rating") > 0, F.col("aggregate_rating"))
    values = df.select(
        rating.alias("aggregate_rating_rated_only"), F.col("votes").cast("double").alias("votes")
    ).unpivot([], ["aggregate_rating_rated_only", "votes"], "measure", "value").where("value is not null")
    lower, upper = fences(F.col("q1"), F.col("q3"))
    fenced = quantiles(values, ["measure"], "value", {"q1": 0.25, "q3": 0.75}, leaf_rows).select(
        "measure", lower.alias("iqr_lower_fence"), upper.alias("iqr_upper_fence")
    )
    outside = (F.col("value") < F.col("iqr_lower_fence")) | (F.col("value") > F.col("iqr_upper_fence"))
    return values.join(fenced, "measure").groupBy("measure", "iqr_lower_fence", "iqr_upper_fence").agg(
        F.count("*").alias("row_count"), F.count_if(outside).alias("flagged_rows")
    )


def code_currency_map(df: DataFrame) -> DataFrame:
    """Sorted distinct currencies of each country code."""
    pairs = df.where(F.col("country_code").isNotNull()).select("country_code", "currency").distinct()
    return pairs.groupBy("country_code").agg(F.sort_array(F.collect_list("currency")).alias("currencies"))


def rating_and_text_differ(rating: Column) -> Column:
    """Whether a rating of 0 and the text for it do not go together."""
    zero = F.coalesce(rating == 0, F.lit(False))
    named = F.coalesce(F.col("rating_text") == NOT_RATED_TEXT, F.lit(False))
    return zero != named


def zero_rating_text_mismatch(df: DataFrame) -> DataFrame:
    """Rows where a rating of 0 and the text for it do not go together."""
    return df.agg(F.count_if(rating_and_text_differ(to_number(F.col("aggregate_rating")))).alias("rating_text_mismatches"))


def flag_domains(df: DataFrame, flags: Sequence[str] = SERVICE_FLAGS) -> DataFrame:
    """Sorted distinct non-missing values of each flag."""
    seen = _long_form(df, flags).distinct().groupBy("column_name")
    return seen.agg(F.sort_array(F.collect_list("value")).alias("flag_values"))


def value_counts(df: DataFrame, column: str = "currency") -> DataFrame:
    """Rows per value, missing included, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias("row_count"))
    return counts.orderBy(F.desc("row_count"), column)


def flag_value_counts(df: DataFrame, flags: Sequence[str] = SERVICE_FLAGS) -> DataFrame:
    long = df.select(*flags).unpivot([], list(flags), "flag_name", "flag_value")
    return long.groupBy("flag_name", "flag_value").agg(F.count("*").alias("row_count")).orderBy(
        "flag_name", F.asc_nulls_last("flag_value")
    )


def cost_outliers(
    df: DataFrame, group: str = "currency", value: str = "average_cost_for_two",
    carried: Sequence[str] = ("restaurant_id", "city"), leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Rows above the upper fence of their group, with the quartiles and the fence."""
    kept = df.where((F.col(value) > 0) & F.col(group).isNotNull()).select(*carried, group, value)
    fenced = quantiles(kept, [group], value, {"q1": 0.25, "q3": 0.75}, leaf_rows).select(
        group, "q1", "q3", fences(F.col("q1"), F.col("q3"))[1].alias("upper_iqr_fence")
    )
    above = kept.join(fenced, group).where(F.col(value) > F.col("upper_iqr_fence"))
    return above.orderBy(group, F.desc(value), *carried)


def column_profile(df: DataFrame) -> DataFrame:
    """Type, missing cells and distinct values (missing counts as one) per column."""
    cells = _long_form(df, df.columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    counts = cells.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("*").alias("unique_values"),
    )
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    return counts.select("column_name", types[F.col("column_name")].alias("dtype"), "missing", "unique_values")


PROFILED = ["country_code", "city", "currency", *SERVICE_FLAGS, "price_range", "rating_text"]


def top_values(df: DataFrame, columns: Sequence[str] = PROFILED, k: int = 15) -> DataFrame:
    """The ``k`` most frequent values of each column, missing included."""
    counts = _long_form(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("row_count"))
    order = Window.partitionBy("column_name").orderBy(F.desc("row_count"), F.asc_nulls_last("value"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


DESCRIBED = ["longitude", "latitude", "average_cost_for_two", "aggregate_rating", "votes"]


def describe_percentiles(
    df: DataFrame, columns: Sequence[str] = DESCRIBED, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Count, mean, deviation, extremes and six percentiles of each numeric column."""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cells = cells.unpivot([], list(columns), "measure", "value").where("value is not null")
    basic = cells.groupBy("measure").agg(
        F.count("value").alias("value_count"), F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    probs = {f"p{round(p * 100)}": p for p in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)}
    return basic.join(quantiles(cells, ["measure"], "value", probs, leaf_rows).drop("n"), "measure", "left")


def zero_coordinate_pairs(df: DataFrame) -> DataFrame:
    pair = (F.col("longitude") == 0) & (F.col("latitude") == 0)
    return df.agg(F.count_if(pair).alias("zero_coordinate_pairs"))


def post_clean_counters(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("restaurant_rows"),
        F.count_distinct("restaurant_id").alias("unique_ids"),
        F.count_if(F.col("cuisines").isNull()).alias("missing_cuisines"),
        F.count_if(F.col("longitude").isNull() | F.col("latitude").isNull()).alias("missing_coordinates"),
        F.count_if(F.col("average_cost_for_two") == 0).alias("zero_costs"),
        F.count_if(F.col("aggregate_rating") == 0).alias("unrated_records"),
        F.sum("cuisine_count").alias("cuisine_rows"),
    )


def constraint_checks(listings: DataFrame, labels: DataFrame) -> DataFrame:
    """Violations of the key, the reference from labels to listings, and label presence."""
    repeated = listings.groupBy("restaurant_id").count().where("count > 1 or restaurant_id is null")
    orphans = labels.join(listings.select("restaurant_id"), "restaurant_id", "left_anti")
    unlabelled = labels.where(F.col("cuisine").isNull())
    found = [("listing_key_unique", repeated), ("label_has_listing", orphans), ("label_not_null", unlabelled)]
    rows = [d.agg(F.count("*").alias("violations")).select(F.lit(n).alias("constraint_name"), "violations")
            for n, d in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def quality_contract(raw_rows: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Pass or fail of each promise cleaning makes."""
    rating, price = F.col("aggregate_rating"), F.col("price_range")
    lon, lat = F.col("longitude"), F.col("latitude")

    def holds(predicate: Column) -> Column:
        return F.coalesce(F.bool_and(F.coalesce(predicate, F.lit(True))), F.lit(True))

    flags = [holds(F.col(c).isin("Yes", "No")).alias(f"{c}_valid") for c in SERVICE_FLAGS]
    checks = cleaned.agg(
        F.count("*").alias("_rows"),
        (F.count_distinct("restaurant_id") == F.count("*")).alias("ids_unique"),
        holds(rating.between(0, 5)).alias("rating_valid"),
        holds(price.isin(PRICE_BANDS)).alias("price_valid"),
        holds(lon.between(-180, 180)).alias("longitude_valid"),
        holds(lat.between(-90, 90)).alias("latitude_valid"),
        *flags,
    )
    before = raw_rows.agg(F.count("*")).scalar()
    both = checks.withColumn("rows_preserved", F.col("_rows") == before)
    return _one_row_to_long(both.drop("_rows"), "check_name", "passed")
