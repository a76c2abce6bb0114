"""Coverage: how many listings, where, and in which bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.functions.means import mean
from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.ranks import LEAF_ROWS, quantiles
from venuegrid.functions.text import label_array
from venuegrid.schema import PRICE_BANDS, RATING_CATEGORIES

RATED = "is_rated"


def rated_mean():
    return mean(F.col("aggregate_rating"), F.col(RATED))


def market_summary(df: DataFrame) -> DataFrame:
    """One line of scope figures; a listing counts once."""
    scope = df.agg(
        F.count_distinct("restaurant_id").alias("restaurants"),
        F.count_distinct("country_code").alias("countries"),
        F.count_distinct("city").alias("cities"),
        F.coalesce(F.sum("votes"), F.lit(0)).alias("total_votes"),
        rated_mean().alias("average_rating"),
        F.count_if(RATED).alias("rated_restaurants"),
    )
    labels = df.select(F.explode(label_array(F.col("cuisines"))).alias("cuisine"))
    return scope.withColumn("cuisines", labels.agg(F.count_distinct("cuisine")).scalar())


def scope_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("restaurants"),
        F.count_distinct("country_code").alias("country_codes"),
        F.count_distinct("city").alias("cities"),
        F.sum("votes").alias("total_votes"),
    )


def country_counts(df: DataFrame) -> DataFrame:
    counts = df.groupBy("country_code").agg(F.count("*").alias("restaurants"))
    return counts.orderBy(F.desc("restaurants"), "country_code")


def city_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("city").agg(
        F.count("*").alias("restaurants"), F.count_if(RATED).alias("rated_restaurants")
    )


def city_counts_topk(df: DataFrame, k: int = 25) -> DataFrame:
    return city_counts(df).orderBy(F.desc("restaurants"), "city").limit(k)


def price_band_share(df: DataFrame) -> DataFrame:
    """Rows and rounded share per price band; the window spans the few bands only."""
    bands = df.groupBy("price_range").agg(F.count("*").alias("restaurants"))
    total = F.sum("restaurants").over(Window.partitionBy())
    share = F.round(F.lit(100).cast("decimal(5,0)") * F.col("restaurants") / total, 2).cast("double")
    return bands.withColumn("share_percent", share).orderBy(F.asc_nulls_last("price_range"))


def price_band_counts(df: DataFrame) -> DataFrame:
    """Rows in each of the four bands, empty bands included."""
    counts = df.agg(*[F.count_if(F.col("price_range") == b).alias(str(b)) for b in PRICE_BANDS])
    long = counts.unpivot([], counts.columns, "price_range", "restaurants")
    return long.withColumn("price_range", F.col("price_range").cast("int")).orderBy("price_range")


def rating_category_counts(df: DataFrame) -> DataFrame:
    """Rows per rating category from worst to best; a missing one sorts with the best."""
    place = F.array_position(F.array(*[F.lit(c) for c in RATING_CATEGORIES]), F.col("rating_category"))
    last = F.lit(len(RATING_CATEGORIES))
    counts = df.groupBy("rating_category").agg(F.count("*").alias("restaurants"))
    return counts.orderBy(F.coalesce(place.cast("int"), last), F.asc_nulls_last("rating_category"))


def city_rank(df: DataFrame) -> DataFrame:
    """Cities by listings inside their country; ranks are over city lines, not rows."""
    cities = df.groupBy("country_code", "city").agg(
        F.count("*").alias("restaurants"), rated_mean().alias("average_rating"),
        F.sum("votes").alias("total_votes"),
    )
    inside = Window.partitionBy("country_code").orderBy(F.desc("restaurants"))
    return cities.withColumn("city_rank", F.dense_rank().over(inside)).orderBy(
        F.desc("restaurants"), "country_code", "city"
    )


def city_screen(df: DataFrame, minimum: int = 5) -> DataFrame:
    cities = df.groupBy("country_code", "city").agg(
        F.count("*").alias("restaurant_count"), F.count_if(RATED).alias("rated_restaurants"),
        rated_mean().alias("average_rating"), F.sum("votes").alias("votes_proxy_not_revenue"),
    )
    return cities.where(F.col("restaurant_count") >= minimum).orderBy(
        "restaurant_count", F.desc_nulls_last("votes_proxy_not_revenue"), "country_code", "city"
    )


def city_coverage(df: DataFrame, k: int = 20, fewest_votes_first: bool = False) -> DataFrame:
    """The cities with the fewest listings; this mean rating includes the unrated zeros."""
    cities = df.where(F.col("city").isNotNull()).groupBy("city").agg(
        F.count_distinct("restaurant_id").alias("restaurants"),
        F.count_if(RATED).alias("rated_restaurants"),
        mean(F.col("aggregate_rating")).alias("average_rating"),
        F.coalesce(F.sum("votes"), F.lit(0)).alias("votes_proxy"),
    )
    votes = F.asc("votes_proxy") if fewest_votes_first else F.desc("votes_proxy")
    return cities.orderBy("restaurants", votes, "city").limit(k)


def city_rating_topk(df: DataFrame, minimum: int = 30, k: int = 15) -> DataFrame:
    cities = df.where(F.col(RATED) & F.col("city").isNotNull()).groupBy("city").agg(
        mean(F.col("aggregate_rating")).alias("average_rating"),
        F.count_distinct("restaurant_id").alias("restaurants"),
    )
    return cities.where(F.col("restaurants") >= minimum).orderBy(F.desc("average_rating"), "city").limit(k)


def city_currency_location(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Per (city, currency): listings, rated mean, and the median cost with zeros included."""
    kept = df.where(F.col("city").isNotNull() & F.col("currency").isNotNull())
    keys = ["city", "currency"]
    cities = kept.groupBy(*keys).agg(
        F.count_distinct("restaurant_id").alias("restaurants"), rated_mean().alias("average_rating")
    )
    medians = quantiles(kept, keys, "average_cost_for_two", {"median_cost": 0.5}, leaf_rows).drop("n")
    return null_safe_join(cities, medians, keys, "left")


def city_currency_topk(df: DataFrame, k: int = 15, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    return city_currency_location(df, leaf_rows).orderBy(F.desc("restaurants"), "city", "currency").limit(k)
