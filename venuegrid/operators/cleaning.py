"""Cleaning: names, text, flags, numbers, domains, coordinates. No row is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.functions.text import snake_case, strip_to_null, to_number, yes_no
from venuegrid.operators.features import add_features
from venuegrid.schema import NUMERIC_TYPES, PRICE_BANDS, SERVICE_FLAGS


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def trim_blank_to_null(df: DataFrame) -> DataFrame:
    """Strip every text column; text that becomes empty is missing."""
    return df.select(*[
        strip_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema
    ])


def normalise_flags(df: DataFrame, flags: list[str] = SERVICE_FLAGS) -> DataFrame:
    return df.withColumns({c: yes_no(F.col(c)) for c in flags})


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Parse the numeric columns; text that does not parse is missing.

    Whole-number columns stay double here, because a price band of 2.5 must
    still be seen as out of domain; ``fix_types`` narrows them afterwards.
    """
    return df.withColumns({c: to_number(F.col(c)) for c in NUMERIC_TYPES})


def null_out_of_domain(df: DataFrame) -> DataFrame:
    """Impossible ratings, price bands, votes and costs become missing."""
    rating, price = F.col("aggregate_rating"), F.col("price_range")
    votes, cost = F.col("votes"), F.col("average_cost_for_two")
    return df.withColumns({
        "aggregate_rating": F.when(rating.between(0, 5), rating),
        "price_range": F.when(price.isin(PRICE_BANDS), price),
        "votes": F.when(votes >= 0, votes),
        "average_cost_for_two": F.when(cost >= 0, cost),
    })


def null_bad_coordinates(df: DataFrame) -> DataFrame:
    """(0, 0) marks an unknown place; otherwise each axis is judged alone."""
    lon, lat = F.col("longitude"), F.col("latitude")
    placeholder = F.coalesce((lon == 0) & (lat == 0), F.lit(False))
    return df.withColumns({
        "longitude": F.when(~placeholder & lon.between(-180, 180), lon),
        "latitude": F.when(~placeholder & lat.between(-90, 90), lat),
    })


def fix_types(df: DataFrame) -> DataFrame:
    """Final column types; the id must parse, so a bad one is left missing for the key check."""
    typed = {c: F.col(c).try_cast(t) for c, t in NUMERIC_TYPES.items()}
    return df.withColumns(typed | {"restaurant_id": F.col("restaurant_id").try_cast("bigint")})


def standardise(raw: DataFrame) -> DataFrame:
    """All cleaning steps as one chain of projections, without features."""
    return (
        raw.transform(snake_case_columns)
        .transform(trim_blank_to_null)
        .transform(normalise_flags)
        .transform(coerce_numeric)
        .transform(null_out_of_domain)
        .transform(null_bad_coordinates)
        .transform(fix_types)
    )


def clean(raw: DataFrame) -> DataFrame:
    """Clean listings with their derived features; one output row per input row.

    The cost categories first write the three columns that they search; the rows
    themselves go from the raw text to the result in one pass.
    """
    return add_features(standardise(raw))
