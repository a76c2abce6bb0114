"""Label screening: rating gap to the currency, damped by presence. Not a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.functions.means import mean
from venuegrid.operators.market import RATED


def _baseline(listings: DataFrame) -> DataFrame:
    rated = listings.where(F.col(RATED) & F.col("currency").isNotNull())
    return rated.groupBy("currency").agg(mean(F.col("aggregate_rating")).alias("market_rating"))


def _score(lines: DataFrame, presence: Column) -> DataFrame:
    gap = F.col("average_rating") - F.col("market_rating")
    scored = lines.withColumn("rating_gap", gap).withColumn("presence_percentile", presence)
    return scored.withColumn(
        "opportunity_score", F.col("rating_gap") * (1 - F.col("presence_percentile"))
    ).orderBy(F.desc_nulls_last("opportunity_score"), "currency", "cuisine")


def label_opportunities(listings: DataFrame, labels: DataFrame, minimum: int = 5) -> DataFrame:
    """Presence is the average-rank percentile; votes and counts are of rated rows only.

    Windows run over (currency, label) lines that are already aggregated.
    """
    known = F.col("currency").isNotNull() & (F.col("aggregate_rating") > 0)
    lines = labels.where(known).groupBy("currency", "cuisine").agg(
        F.count_distinct("restaurant_id").alias("restaurant_count"),
        mean(F.col("aggregate_rating")).alias("average_rating"),
        F.coalesce(F.sum("votes"), F.lit(0)).alias("total_votes"),
    ).where(F.col("restaurant_count") >= minimum)
    by_count = Window.partitionBy("currency").orderBy("restaurant_count")
    ties = F.count("*").over(Window.partitionBy("currency", "restaurant_count"))
    size = F.count("*").over(Window.partitionBy("currency"))
    presence = (F.rank().over(by_count) + (ties - 1) / 2) / size
    return _score(lines.join(_baseline(listings), "currency", "left"), presence)


def label_opportunities_sql(listings: DataFrame, labels: DataFrame, minimum: int = 5) -> DataFrame:
    """Presence is ``percent_rank``; votes are of all label rows; unmatched currencies drop out."""
    rating = F.col("aggregate_rating")
    lines = labels.groupBy("currency", "cuisine").agg(
        F.count_distinct(F.when(rating > 0, F.col("restaurant_id"))).alias("restaurant_count"),
        mean(rating, rating > 0).alias("average_rating"), F.sum("votes").alias("total_votes"),
    ).where(F.col("restaurant_count") >= minimum)
    by_count = Window.partitionBy("currency").orderBy("restaurant_count")
    return _score(lines.join(_baseline(listings), "currency"), F.percent_rank().over(by_count))
