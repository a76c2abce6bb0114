"""Label (cuisine) questions; listings are counted by distinct id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.functions.means import mean
from venuegrid.functions.spread import spread
from venuegrid.functions.text import label_array
from venuegrid.operators.market import RATED


def _by_listing(labels: DataFrame, *columns: str) -> DataFrame:
    """The label rows with these columns, dealt out by label and listing, so that listings are told apart where they arrive."""
    return spread(labels.select("cuisine", "restaurant_id", *columns), labels.count(), "cuisine", "restaurant_id")


def top_labels(labels: DataFrame, k: int = 30) -> DataFrame:
    """Labels by distinct listings; votes count once for each label of a listing."""
    groups = _by_listing(labels, "votes").groupBy("cuisine").agg(
        F.count_distinct("restaurant_id").alias("restaurant_count"), F.sum("votes").alias("associated_votes")
    )
    return groups.orderBy(F.desc("restaurant_count"), "cuisine").limit(k)


def label_rating(labels: DataFrame, minimum: int = 30) -> DataFrame:
    """Rated mean per label; the minimum counts all listings of the label."""
    rating = F.col("aggregate_rating")
    groups = _by_listing(labels, "aggregate_rating", "votes").groupBy("cuisine").agg(
        F.count_distinct("restaurant_id").alias("restaurants"),
        mean(rating, rating > 0).alias("average_rating"), F.sum("votes").alias("associated_votes"),
    )
    return groups.where(F.col("restaurants") >= minimum).orderBy(F.desc_nulls_last("average_rating"), "cuisine")


def label_rating_topk(labels: DataFrame, minimum: int = 50, k: int = 15) -> DataFrame:
    """Best labels by rated mean; the minimum counts rated listings only."""
    groups = _by_listing(labels, "aggregate_rating").where(F.col("aggregate_rating") > 0).groupBy("cuisine").agg(
        mean(F.col("aggregate_rating")).alias("average_rating"),
        F.count_distinct("restaurant_id").alias("restaurants"),
    )
    return groups.where(F.col("restaurants") >= minimum).orderBy(F.desc("average_rating"), "cuisine").limit(k)


def top3_labels_per_city(labels: DataFrame, k: int = 3) -> DataFrame:
    """Leading labels of each city; equal counts share a rank, so ties can exceed ``k``."""
    groups = labels.groupBy("city", "cuisine").agg(
        F.count_distinct("restaurant_id").alias("restaurants"), F.sum("votes").alias("associated_votes")
    )
    inside = Window.partitionBy("city").orderBy(F.desc("restaurants"))
    ranked = groups.withColumn("cuisine_rank", F.rank().over(inside)).where(F.col("cuisine_rank") <= k)
    return ranked.orderBy("city", "cuisine_rank", "cuisine").drop("cuisine_rank")


def label_currency_join(labels: DataFrame, listings: DataFrame, minimum: int = 5, rows: int | None = None) -> DataFrame:
    """Labels joined back to their listings: count, rated mean, mean cost per (label, currency).

    With the number of label ``rows`` both tables are dealt out by listing over as many tasks as that needs;
    bucketed tables are joined as they lie.
    """
    facts = listings.select("restaurant_id", "currency", "aggregate_rating", RATED, "average_cost_for_two")
    tokens = labels.select("restaurant_id", "cuisine")
    if rows is not None:
        tokens, facts = spread(tokens, rows, "restaurant_id"), spread(facts, rows, "restaurant_id")
    joined = tokens.join(facts, "restaurant_id")
    cost = F.col("average_cost_for_two")
    groups = joined.groupBy("cuisine", "currency").agg(
        F.count_distinct("restaurant_id").alias("restaurant_count"),
        mean(F.col("aggregate_rating"), F.col(RATED)).alias("average_rating"),
        mean(cost, cost > 0).alias("mean_local_cost"),
    )
    return groups.where(F.col("restaurant_count") >= minimum).orderBy(
        "currency", F.desc("restaurant_count"), "cuisine"
    )


def city_label_pivot(listings: DataFrame, labels: DataFrame, k: int = 12) -> DataFrame:
    """Distinct listings of the leading labels (columns) in the leading cities (rows).

    The label names become column names, so the ``k`` names are read first.
    """
    cities = listings.where(F.col("city").isNotNull()).groupBy("city").agg(F.count("*").alias("n"))
    cities = cities.orderBy(F.desc("n"), "city").limit(k).select("city")
    leading = labels.groupBy("cuisine").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cuisine").limit(k)
    names = sorted(row["cuisine"] for row in leading.collect())
    kept = labels.where(F.col("cuisine").isin(names)).join(cities, "city", "left_semi")
    counts = kept.groupBy("city", "cuisine").agg(F.count_distinct("restaurant_id").alias("n"))
    return counts.groupBy("city").pivot("cuisine", names).agg(F.first("n")).na.fill(0)


def distinct_labels(listings: DataFrame) -> DataFrame:
    return listings.select(F.explode(label_array(F.col("cuisines"))).alias("cuisine")).distinct()
