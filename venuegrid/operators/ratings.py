"""Ratings and votes of listings; a rating of 0 means not rated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.means import mean
from venuegrid.functions.ranks import LEAF_ROWS, quantiles
from venuegrid.operators.market import RATED, rated_mean


def overall_rating(df: DataFrame) -> DataFrame:
    return df.agg(rated_mean().alias("average_rating"), F.count_if(~F.col(RATED)).alias("unrated_restaurants"))


def top_rated(df: DataFrame, k: int = 25) -> DataFrame:
    best = df.where(RATED).select(
        "restaurant_id", "restaurant_name", "city", "aggregate_rating", "votes", "cuisines", "price_range"
    )
    return best.orderBy(F.desc("aggregate_rating"), F.desc_nulls_last("votes"), "restaurant_id").limit(k)


def top_voted(df: DataFrame, k: int = 25) -> DataFrame:
    rows = df.select("restaurant_id", "restaurant_name", "city", "aggregate_rating", "votes")
    return rows.orderBy(F.desc_nulls_last("votes"), "restaurant_id").limit(k)


def rating_by_price(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rated rows, mean and median rating per price band."""
    bands = df.groupBy("price_range").agg(F.count_if(RATED).alias("rated_restaurants"), rated_mean().alias("average_rating"))
    medians = quantiles(df.where(RATED), ["price_range"], "aggregate_rating", {"median_rating": 0.5}, leaf_rows).drop("n")
    return null_safe_join(bands, medians, ["price_range"], "left").orderBy(F.asc_nulls_last("price_range"))


def rating_by_flag(df: DataFrame, flag: str) -> DataFrame:
    """Per flag value, missing included: rated rows, rated mean, mean votes of all rows."""
    return df.groupBy(flag).agg(
        F.count_if(RATED).alias("rated_restaurants"), rated_mean().alias("average_rating"),
        F.avg("votes").alias("average_votes"),
    )


def rating_by_delivery(df: DataFrame) -> DataFrame:
    return rating_by_flag(df, "has_online_delivery")


def rating_by_booking(df: DataFrame) -> DataFrame:
    return rating_by_flag(df, "has_table_booking")


def _single(df: DataFrame, value: str, p: float, leaf_rows: int) -> Column:
    """One overall quantile as a scalar."""
    return quantiles(df, [], value, {"q": p}, leaf_rows).select("q").scalar()


def high_votes_low_ratings(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rated rows in the top quarter by votes and the bottom quarter by rating."""
    rated = df.where(RATED).select("restaurant_id", "restaurant_name", "city", "aggregate_rating", "votes")
    low = _single(rated, "aggregate_rating", 0.25, leaf_rows)
    many = _single(rated, "votes", 0.75, leaf_rows)
    found = rated.where((F.col("votes") >= many) & (F.col("aggregate_rating") <= low))
    return found.orderBy(F.desc("votes"), "aggregate_rating", "restaurant_id")


def high_rating_low_votes(df: DataFrame, floor: float = 4.0, k: int = 15, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Well-rated rows with few votes; the vote quartile is over all rows of the slice."""
    few = _single(df, "votes", 0.25, leaf_rows)
    rows = df.where(F.col(RATED) & (F.col("aggregate_rating") >= floor) & (F.col("votes") <= few))
    rows = rows.select("restaurant_id", "restaurant_name", "city", "cuisines", "aggregate_rating", "votes")
    return rows.orderBy(F.desc("aggregate_rating"), "restaurant_id").limit(k)


def votes_rating_points(df: DataFrame) -> DataFrame:
    return df.where(RATED).select("restaurant_id", "restaurant_name", "votes", "aggregate_rating", "price_range")


def rating_box_stats(df: DataFrame, flag: str = "has_online_delivery", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Box-plot numbers of rated ratings per flag value.

    Whiskers are the outermost ratings within 1.5 quartile ranges of the box.
    """
    rows = df.where(F.col(RATED) & F.col(flag).isNotNull())
    boxes = quantiles(rows, [flag], "aggregate_rating", {"q1": 0.25, "median": 0.5, "q3": 0.75}, leaf_rows).drop("n")
    rated = rows.groupBy(flag, "aggregate_rating").agg(F.count("*").alias("_n"))
    r = F.col("aggregate_rating")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    within = r.between(F.col("q1") - spread, F.col("q3") + spread)
    return rated.join(boxes, flag).groupBy(flag, "q1", "median", "q3").agg(
        F.min(F.when(within, r)).alias("whisker_low"),
        F.max(F.when(within, r)).alias("whisker_high"),
        F.sum("_n").alias("rated_restaurants"),
        F.sum(F.when(within, 0).otherwise(F.col("_n"))).alias("outliers"),
    )


def rating_histogram(df: DataFrame, bins: int = 20, top: float = 5.0) -> DataFrame:
    """Rows per equally wide rating bin over [0, top]; the last bin includes the top."""
    r = F.col("aggregate_rating")
    number = F.least(F.floor(r * F.lit(bins) / F.lit(top)).cast("int"), F.lit(bins - 1))
    width = top / bins
    counts = df.where(r.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("restaurants"))
    return counts.withColumns({
        "bin_low": F.round(F.col("bin") * F.lit(width), 9), "bin_high": F.round((F.col("bin") + 1) * F.lit(width), 9)
    }).orderBy("bin")


def rating_by_price_mean(df: DataFrame) -> DataFrame:
    """Mean rated rating per known price band."""
    kept = df.where(F.col(RATED) & F.col("price_range").isNotNull())
    return kept.groupBy("price_range").agg(mean(F.col("aggregate_rating")).alias("average_rating"))
