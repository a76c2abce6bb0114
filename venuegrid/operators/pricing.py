"""Prices; a raw cost is only ever aggregated inside one currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.means import mean
from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.ranks import LEAF_ROWS, quantiles
from venuegrid.operators.market import RATED, rated_mean

COST = "average_cost_for_two"
PICKED = [
    "restaurant_id", "restaurant_name", "city", "currency", COST, "price_range", "aggregate_rating", "votes",
]


def _mean_cost():
    return mean(F.col(COST), F.col(COST) > 0)


def city_currency_cost(df: DataFrame, minimum: int = 5, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Positive costs per (city, currency), missing keys included: rows, mean, median."""
    priced = df.where(F.col(COST) > 0).select("city", "currency", COST)
    keys = ["city", "currency"]
    groups = priced.groupBy(*keys).agg(
        F.count("*").alias("restaurants"), mean(F.col(COST)).alias("mean_cost_for_two")
    ).where(F.col("restaurants") >= minimum)
    medians = quantiles(priced, keys, COST, {"median_cost_for_two": 0.5}, leaf_rows).drop("n")
    return null_safe_join(groups, medians, keys).orderBy(F.desc("restaurants"), "city", "currency")


def city_costs(df: DataFrame) -> DataFrame:
    kept = df.where((F.col(COST) > 0) & F.col("city").isNotNull() & F.col("currency").isNotNull())
    return kept.groupBy("city", "currency").agg(
        mean(F.col(COST)).alias("mean_cost"), F.count_distinct("restaurant_id").alias("restaurants")
    )


def city_cost_panels(df: DataFrame, minimum: int = 10, currencies: int = 6) -> DataFrame:
    """City means for the currencies with most listings among the cities kept."""
    kept = city_costs(df).where(F.col("restaurants") >= minimum)
    leading = kept.groupBy("currency").agg(F.sum("restaurants").alias("n"))
    leading = leading.orderBy(F.desc("n"), "currency").limit(currencies)
    return kept.join(leading.select("currency"), "currency", "left_semi")


def city_cost_topk(df: DataFrame, k: int = 20) -> DataFrame:
    return city_costs(df).orderBy(F.desc("restaurants"), "city", "currency").limit(k)


def currency_price_band(df: DataFrame) -> DataFrame:
    """Per (currency, band): rows, mean cost with zeros included, rated mean."""
    return df.groupBy("currency", "price_range").agg(
        F.count("*").alias("restaurants"), mean(F.col(COST)).alias("mean_cost_for_two"),
        rated_mean().alias("average_rating"),
    ).orderBy(F.asc_nulls_last("currency"), F.asc_nulls_last("price_range"))


def band_picks(df: DataFrame, band: int, floor: float = 4.0) -> DataFrame:
    best = df.where(F.col(RATED) & (F.col("price_range") == band) & (F.col("aggregate_rating") >= floor))
    return best.select(*PICKED).orderBy(
        F.desc("aggregate_rating"), F.desc_nulls_last("votes"), "restaurant_id"
    )


def value_picks(df: DataFrame, floor: float = 4.0) -> DataFrame:
    return band_picks(df, 1, floor)


def premium_picks(df: DataFrame, floor: float = 4.0) -> DataFrame:
    return band_picks(df, 4, floor)


def cost_rating_observations(df: DataFrame) -> DataFrame:
    return df.where((F.col(COST) > 0) & F.col(RATED)).select("currency", COST, "aggregate_rating", "votes")


def label_currency_cost(labels: DataFrame, minimum: int = 5, k: int = 15) -> DataFrame:
    kept = labels.where((F.col(COST) > 0) & F.col("currency").isNotNull())
    groups = kept.groupBy("cuisine", "currency").agg(
        mean(F.col(COST)).alias("mean_cost"), F.count_distinct("restaurant_id").alias("restaurants")
    )
    return groups.where(F.col("restaurants") >= minimum).orderBy(
        F.desc("restaurants"), "cuisine", "currency"
    ).limit(k)


def single_currency_mean(df: DataFrame) -> DataFrame:
    """Mean positive cost when the slice has exactly one currency, else why there is none."""
    # Lowest and highest name tell one currency from several without a distinct count.
    seen = df.agg(
        F.min("currency").alias("_first"), F.max("currency").alias("_last"), _mean_cost().alias("_mean")
    )
    one = F.col("_first") == F.col("_last")
    status = (
        F.when(F.col("_first").isNull(), "N/A").when(~one, "Multiple currencies")
        .when(F.col("_mean").isNull(), "N/A").otherwise("Single currency")
    )
    usable = status == "Single currency"
    return seen.select(
        status.alias("status"), F.when(usable, F.col("_first")).alias("currency"),
        F.when(usable, F.col("_mean")).alias("mean_cost"),
    )
