"""Adoption and comparison of the four service flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.operators.market import RATED, rated_mean
from venuegrid.schema import SERVICE_NAMES


def _by_service(df: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per listing and service; one scan serves all four services."""
    named = df.select(*carried, *[F.col(c).alias(n) for c, n in SERVICE_NAMES.items()])
    long = named.unpivot(list(carried), list(SERVICE_NAMES.values()), "service", "availability")
    return long.where(F.col("availability").isNotNull())


def flag_adoption(
    df: DataFrame, flags: Sequence[str] = ("has_online_delivery", "has_table_booking")
) -> DataFrame:
    """Yes and No rows per flag; a value that never occurs shows as zero."""
    cells = [(f, v) for f in flags for v in ("Yes", "No")]
    counts = df.agg(*[F.count_if(F.col(f) == v).alias(f"{f}|{v}") for f, v in cells])
    long = counts.unpivot([], counts.columns, "cell", "restaurants")
    return long.select(
        F.split_part("cell", F.lit("|"), F.lit(1)).alias("flag_name"),
        F.split_part("cell", F.lit("|"), F.lit(2)).alias("availability"), "restaurants",
    )


def adoption_share(df: DataFrame) -> DataFrame:
    """Share of each answer inside its service, missing answers left out."""
    counts = _by_service(df).groupBy("service", "availability").agg(F.count("*").alias("restaurants"))
    total = F.sum("restaurants").over(Window.partitionBy("service"))
    return counts.withColumn("share_percent", F.col("restaurants") / total * 100)


def service_comparison(df: DataFrame) -> DataFrame:
    """Per service and answer: listings, mean votes, rated mean rating."""
    long = _by_service(df, ["restaurant_id", "votes", "aggregate_rating", RATED])
    return long.groupBy("service", "availability").agg(
        F.count_distinct("restaurant_id").alias("restaurants"), F.avg("votes").alias("average_votes"),
        rated_mean().alias("average_rating"),
    )


def price_service_crosstab(df: DataFrame) -> DataFrame:
    known = df.where(F.col("price_range").isNotNull() & F.col("has_online_delivery").isNotNull())
    return known.groupBy("price_range", "has_online_delivery").agg(
        F.count_distinct("restaurant_id").alias("restaurants")
    )
