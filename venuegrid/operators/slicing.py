"""Conjunctive filters over listings and their labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.schema import PRICE_BANDS

RATING_RANGE = (0.0, 4.9)


def filter_by_label(listings: DataFrame, labels: DataFrame, cuisines: Sequence[str]) -> DataFrame:
    """Listings that have any of the labels."""
    chosen = labels.where(F.col("cuisine").isin(list(cuisines))).select("restaurant_id")
    return listings.join(chosen, "restaurant_id", "left_semi")


def place_filters(df: DataFrame, **chosen: Sequence) -> DataFrame:
    """Rows with one of the chosen values in each column; an empty choice means no filter."""
    for column, values in chosen.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def slice_listings(
    listings: DataFrame,
    labels: DataFrame | None = None,
    countries: Sequence[int] = (),
    currencies: Sequence[str] = (),
    cities: Sequence[str] = (),
    cuisines: Sequence[str] = (),
    prices: Sequence[int] = tuple(PRICE_BANDS),
    rating: tuple[float, float] = RATING_RANGE,
    booking: str | None = None,
    delivery: str | None = None,
) -> DataFrame:
    """An empty choice means no filter, except price band and rating, which always apply.

    So rows without a price band or rating leave the slice.
    """
    df = place_filters(listings, country_code=countries, currency=currencies, city=cities)
    df = df.where(F.col("price_range").isin(list(prices)) & F.col("aggregate_rating").between(*rating))
    if booking:
        df = df.where(F.col("has_table_booking") == booking)
    if delivery:
        df = df.where(F.col("has_online_delivery") == delivery)
    return filter_by_label(df, labels, cuisines) if cuisines else df


def slice_labels(labels: DataFrame, listings: DataFrame) -> DataFrame:
    """Label rows whose listing is in the slice."""
    return labels.join(listings.select("restaurant_id"), "restaurant_id", "left_semi")


def option_lists(
    listings: DataFrame,
    labels: DataFrame,
    countries: Sequence[int] = (),
    currencies: Sequence[str] = (),
    cities: Sequence[str] = (),
) -> DataFrame:
    """What can still be chosen in each filter, given the choices before it."""
    in_country = place_filters(listings, country_code=countries)
    in_currency = place_filters(in_country, currency=currencies)
    in_city = place_filters(in_currency, city=cities)
    offered = {
        "country_code": listings, "currency": in_country, "city": in_currency,
        "cuisine": slice_labels(labels, in_city),
    }
    lists = [
        rows.where(F.col(c).isNotNull()).select(
            F.lit(c).alias("filter_name"), F.col(c).cast("string").alias("option_value")
        ).distinct()
        for c, rows in offered.items()
    ]
    return reduce(DataFrame.unionByName, lists).orderBy("filter_name", "option_value")
