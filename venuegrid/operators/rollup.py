"""Figures of any slice from a roll-up, without reading the listings again.

A cell holds the listings that agree in everything a slice can choose by. Counts and
sums of a slice are sums over its cells. Distinct listings are too, but for ids that
occur in several cells: these few are kept beside the cells, and a slice takes off
what they were counted too often. So every answer is exact, also where ids repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.functions.text import label_array
from venuegrid.operators import slicing
from venuegrid.operators.market import RATED
from venuegrid.schema import LABEL_SCHEMA, LISTING_SCHEMA
from venuegrid.session import scratch, settle
from venuegrid.sources import files

CELL = [
    "country_code", "currency", "city", "price_range", "aggregate_rating", RATED, "has_table_booking", "has_online_delivery",
]
_CELL_FIELDS = [LISTING_SCHEMA[c] for c in CELL]
_COUNT = T.LongType()
SCHEMAS = {
    "cells": T.StructType([*_CELL_FIELDS, *[T.StructField(c, _COUNT) for c in ("rows", "votes", "ids")]]),
    "shared": T.StructType([*_CELL_FIELDS, LISTING_SCHEMA["restaurant_id"]]),
    "cuisines": T.StructType([*_CELL_FIELDS, LABEL_SCHEMA["cuisine"], T.StructField("rows", _COUNT)]),
}


@dataclass(frozen=True)
class Rollup:
    """``cells``: rows, votes and distinct ids of each cell; ``shared``: the cells of each id that has several; ``cuisines``: label rows by cell."""

    cells: DataFrame
    shared: DataFrame
    cuisines: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def build_rollup(listings: DataFrame) -> Rollup:
    """One pass for the cells, one for the labels.

    Rows are aggregated by (cell, id) before anything else, so a hot id or a hot cell
    shuffles as few lines. A listing without an id counts as a row, never as an id.
    """
    members = listings.groupBy(*CELL, "restaurant_id").agg(F.count("*").alias("rows"), F.sum("votes").alias("votes"))
    members = settle(members, "members")
    cells = members.groupBy(*CELL).agg(F.sum("rows").alias("rows"), F.sum("votes").alias("votes"), F.count("restaurant_id").alias("ids"))
    known = members.where(F.col("restaurant_id").isNotNull())
    several = known.groupBy("restaurant_id").agg(F.count("*").alias("n")).where("n > 1").select("restaurant_id")
    shared = known.join(several, "restaurant_id", "left_semi").select(*CELL, "restaurant_id")
    labels = listings.select(*CELL, F.explode(label_array(F.col("cuisines"))).alias("cuisine"))
    return Rollup(cells, shared, labels.groupBy(*CELL, "cuisine").agg(F.count("*").alias("rows")))


def write_rollup(listings: DataFrame, path: str) -> Rollup:
    """Build the roll-up, write its three tables below ``path`` and read them back."""
    spark = listings.sparkSession
    with scratch(spark):
        for name, rows in build_rollup(listings).tables().items():
            files.write_table(rows, f"{path}/{name}")
    return load_rollup(spark, path)


def load_rollup(spark: SparkSession, path: str) -> Rollup:
    return Rollup(**{name: files.load_processed(spark, f"{path}/{name}", schema) for name, schema in SCHEMAS.items()})


def slice_rollup(rollup: Rollup, **choices) -> Rollup:
    """The roll-up of a slice, with the choices of ``slice_listings``; labels of a listing are no part of a cell."""
    if choices.get("cuisines"):
        raise ValueError("a roll-up has no slices by cuisine; use slice_listings")
    return Rollup(**{name: slicing.slice_listings(rows, **choices) for name, rows in rollup.tables().items()})


def _figures(rollup: Rollup, keys: Sequence[str]) -> DataFrame:
    """Sums by ``keys``: a shared id was counted in each of its cells and is one listing of a group."""
    repeats = rollup.shared.groupBy(*dict.fromkeys([*keys, "restaurant_id"])).agg((1 - F.count("*")).alias("ids"))
    parts = rollup.cells.unionByName(repeats.drop("restaurant_id"), allowMissingColumns=True)
    rated = F.col(RATED) & F.col("aggregate_rating").isNotNull()
    return parts.groupBy(*keys).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("listing_rows"),
        F.coalesce(F.sum("ids"), F.lit(0)).alias("restaurants"),
        F.coalesce(F.sum(F.when(F.col(RATED), F.col("rows"))), F.lit(0)).alias("rated_restaurants"),
        F.sum("votes").alias("total_votes"),
        F.try_divide(F.sum(F.when(rated, F.col("aggregate_rating") * F.col("rows"))), F.sum(F.when(rated, F.col("rows")))).alias("average_rating"),
    )


def rollup_counts(rollup: Rollup, keys: Sequence[str]) -> DataFrame:
    """For each group of ``keys`` (columns of a cell): rows, distinct listings, rated rows, votes and rated mean."""
    unknown = sorted(set(keys) - set(CELL))
    if unknown or not keys:
        raise ValueError(f"a roll-up counts by columns of its cells, not by {unknown}")
    return _figures(rollup, keys).orderBy(*keys)


def rollup_summary(rollup: Rollup) -> DataFrame:
    """The line of ``market_summary`` for the listings of the roll-up."""
    cells, labels = rollup.cells, rollup.cuisines
    totals = _figures(rollup, []).select("restaurants", F.coalesce("total_votes", F.lit(0)).alias("total_votes"), "average_rating", "rated_restaurants")
    return totals.withColumns({
        "countries": cells.agg(F.count_distinct("country_code")).scalar(),
        "cities": cells.agg(F.count_distinct("city")).scalar(),
        "cuisines": labels.agg(F.count_distinct("cuisine")).scalar(),
    })


def rollup_option_lists(rollup: Rollup, countries: Sequence[int] = (), currencies: Sequence[str] = (), cities: Sequence[str] = ()) -> DataFrame:
    """``option_lists`` from the cells: what can still be chosen in each filter, given the choices before it."""
    chosen = {"country_code": countries, "currency": currencies, "city": cities}
    offered = [("country_code", rollup.cells), ("currency", rollup.cells), ("city", rollup.cells), ("cuisine", rollup.cuisines)]
    lists = []
    for turn, (column, cells) in enumerate(offered):
        rows = slicing.place_filters(cells, **dict(list(chosen.items())[:turn])).where(F.col(column).isNotNull())
        lists.append(rows.select(F.lit(column).alias("filter_name"), F.col(column).cast("string").alias("option_value")).distinct())
    return reduce(DataFrame.unionByName, lists).orderBy("filter_name", "option_value")
