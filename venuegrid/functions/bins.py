"""Boolean indicators and right-closed category bins; flags are never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(predicate: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(predicate, F.lit(False))


def any_yes(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, [truth(f == "Yes") for f in flags])


def rating_category(r: Column) -> Column:
    # Upper edges and names, lowest first.
    named = (
        F.when(r <= 0, "Not rated").when(r <= 2.9, "Low").when(r <= 3.4, "Fair")
        .when(r <= 3.9, "Good").when(r <= 4.4, "Very good").when(r <= 5.0, "Excellent")
    )
    return F.when(r > -0.01, named)


def vote_category(v: Column) -> Column:
    # Upper edges and names, lowest first.
    named = (
        F.when(v <= 0, "No votes").when(v <= 10, "1-10").when(v <= 100, "11-100")
        .when(v <= 500, "101-500").otherwise("501+")
    )
    return F.when(v > -1, named)
