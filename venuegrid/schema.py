"""Column names, types and fixed business values of the listing model."""

from __future__ import annotations

from pyspark.sql import types as T

# The 21 source headers, in file order.
SOURCE_HEADERS = [
    "Restaurant ID", "Restaurant Name", "Country Code", "City", "Address",
    "Locality", "Locality Verbose", "Longitude", "Latitude", "Cuisines",
    "Average Cost for two", "Currency", "Has Table booking",
    "Has Online delivery", "Is delivering now", "Switch to order menu",
    "Price range", "Aggregate rating", "Rating color", "Rating text", "Votes",
]

RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in SOURCE_HEADERS])

SERVICE_FLAGS = ["has_table_booking", "has_online_delivery", "is_delivering_now", "switch_to_order_menu"]

# Column -> type after coercion; anything that does not parse becomes null.
NUMERIC_TYPES = {
    "country_code": "int",
    "longitude": "double",
    "latitude": "double",
    "average_cost_for_two": "double",
    "price_range": "int",
    "aggregate_rating": "double",
    "votes": "bigint",
}

BASE_SCHEMA = T.StructType([
    T.StructField("restaurant_id", T.LongType()),
    T.StructField("restaurant_name", T.StringType()),
    T.StructField("country_code", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("locality", T.StringType()),
    T.StructField("locality_verbose", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("cuisines", T.StringType()),
    T.StructField("average_cost_for_two", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("has_table_booking", T.StringType()),
    T.StructField("has_online_delivery", T.StringType()),
    T.StructField("is_delivering_now", T.StringType()),
    T.StructField("switch_to_order_menu", T.StringType()),
    T.StructField("price_range", T.IntegerType()),
    T.StructField("aggregate_rating", T.DoubleType()),
    T.StructField("rating_color", T.StringType()),
    T.StructField("rating_text", T.StringType()),
    T.StructField("votes", T.LongType()),
])

FEATURE_SCHEMA = T.StructType([
    T.StructField("cuisine_count", T.IntegerType()),
    T.StructField("is_rated", T.BooleanType()),
    T.StructField("is_high_rated", T.BooleanType()),
    T.StructField("is_low_rated", T.BooleanType()),
    T.StructField("is_affordable", T.BooleanType()),
    T.StructField("is_expensive", T.BooleanType()),
    T.StructField("has_digital_service", T.BooleanType()),
    T.StructField("has_booking_or_delivery", T.BooleanType()),
    T.StructField("rating_category", T.StringType()),
    T.StructField("vote_category", T.StringType()),
    T.StructField("cost_category", T.StringType()),
])

LISTING_SCHEMA = T.StructType(BASE_SCHEMA.fields + FEATURE_SCHEMA.fields)

LABEL_SCHEMA = T.StructType([
    BASE_SCHEMA[c] for c in (
        "restaurant_id", "country_code", "city", "locality", "currency",
        "average_cost_for_two", "price_range", "aggregate_rating", "votes",
        "has_table_booking", "has_online_delivery",
    )
] + [T.StructField("cuisine", T.StringType())])

# Category names and their order.
RATING_CATEGORIES = ["Not rated", "Low", "Fair", "Good", "Very good", "Excellent"]
COST_CATEGORIES = [
    "Low within currency", "Lower-middle within currency",
    "Upper-middle within currency", "High within currency",
]
COST_UNKNOWN = "Unknown"
COST_TOO_FEW = "Insufficient currency group"
PRICE_BANDS = [1, 2, 3, 4]
NOT_RATED_TEXT = "Not rated"
SERVICE_NAMES = {
    "has_online_delivery": "Online delivery",
    "has_table_booking": "Table booking",
    "is_delivering_now": "Delivering now",
    "switch_to_order_menu": "Order menu",
}

# Field texts a CSV reader takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

EARTH_RADIUS_M = 6_371_008.8
