"""The listing model on the star-schema test tables: one listing per order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuegrid.functions.spread import spread
from venuegrid.operators.features import add_features
from venuegrid.plans.publish import Tables, ensure_materialised
from venuegrid.schema import BASE_SCHEMA, SOURCE_HEADERS
from venuegrid.session import settle, work_path

_FOLDERS: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and what their lines add up to: all that listings are made of, but the names of nations and regions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("shuffle_hash")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).where(F.col("l_orderkey").isNotNull())
    # Whole lines are dealt out by order before they are counted: sets of names made before the shuffle would not be smaller than the lines.
    points = F.round(F.col("l_discount") * 100).cast("int").alias("points")
    dealt = spread(lines.select("l_orderkey", "p_name", points, "l_quantity", "l_returnflag"), table(spark, sf_dir, "lineitem").count(), "l_orderkey")
    per_order = dealt.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("cuisines"),
        ((F.sum("points") % 51).cast("double") / F.lit(10).cast("double")).alias("rating"),
        F.sum("l_quantity").cast("bigint").alias("votes"),
        F.max("l_returnflag").alias("flag"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").hint("shuffle_hash")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("o_priority")
    )
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("o_custkey", "c_custkey", "l_orderkey")


def _listed(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Typed listings before features, in the column order of the model."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    rating = F.coalesce("rating", F.lit(0.0))
    quarters = F.floor(F.col("o_totalprice") * 4) / 4  # sums of quarters are exact, so means are equal to the last bit
    columns = {
        "restaurant_id": key,
        "restaurant_name": F.col("c_name"),
        "country_code": F.col("n_regionkey"),
        "city": F.col("n_name"),
        "address": F.col("c_name"),
        "locality": F.col("r_name"),
        "locality_verbose": F.concat_ws(", ", "n_name", "r_name"),
        "longitude": (key * 7919 % 361 - 180).cast("double"),
        "latitude": (key * 104729 % 181 - 90).cast("double"),
        "cuisines": F.col("cuisines"),
        "average_cost_for_two": F.when(key % 500 == 0, F.lit(0.0)).otherwise(quarters),
        "currency": F.col("c_mktsegment"),
        "has_table_booking": F.when(F.col("flag") == "R", "Yes").when(F.col("flag").isNotNull(), "No"),
        "has_online_delivery": F.when(status == "F", "Yes").when(status == "O", "No"),
        "is_delivering_now": F.lit("No"),
        "switch_to_order_menu": F.lit("No"),
        "price_range": F.col("o_priority").try_cast("int"),
        "aggregate_rating": rating,
        "rating_color": F.when(rating > 0, "Rated").otherwise("White"),
        "rating_text": F.when(rating > 0, "Rated").otherwise("Not rated"),
        "votes": F.coalesce("votes", F.lit(0)),
    }
    columns["price_range"] = F.when(columns["price_range"].between(1, 4), columns["price_range"])
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in BASE_SCHEMA])


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, _orders(spark, sf_dir))


def build_tables(spark: SparkSession, sf_dir: str, out: str) -> Tables:
    """The columns are made of the stored orders, so that each is stored once."""
    return ensure_materialised(spark, out, lambda: add_features(_listed(spark, sf_dir, settle(_orders(spark, sf_dir), "market"))))


def listing_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Feature-complete listings and labels, written once per application and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        _FOLDERS[key] = work_path(spark, "tables")
    return build_tables(spark, sf_dir, _FOLDERS[key])


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings as untidy text under the source headers: padding, odd flags, bad numbers."""
    m = market(spark, sf_dir)
    key = F.col("restaurant_id")

    def every(n: int) -> Column:
        return key % n == 0

    text = {c: F.col(c).cast("string") for c in m.columns}
    city, rating = text["city"], text["aggregate_rating"]
    text |= {
        "city": F.when(every(11), F.concat(F.lit("\t "), city, F.lit(" 　"))).otherwise(city),
        "locality": F.when(every(13), F.lit("   ")).otherwise(text["locality"]),
        "has_table_booking": F.when(every(7), F.lit("maybe")).when(every(5), F.lit(" YES ")).otherwise(text["has_table_booking"]),
        "has_online_delivery": F.lower(text["has_online_delivery"]),
        "aggregate_rating": F.when(every(101), F.lit("5.5")).when(every(103), F.lit("-")).otherwise(rating),
        "price_range": F.when(every(17), F.lit("0")).when(every(37), F.lit("two")).otherwise(text["price_range"]),
        "votes": F.when(every(19), F.lit("-1")).otherwise(text["votes"]),
        "average_cost_for_two": F.when(every(23), F.lit("-1")).otherwise(text["average_cost_for_two"]),
        "longitude": F.when(every(29), F.lit("0")).when(every(31), F.lit("181")).otherwise(text["longitude"]),
        "latitude": F.when(every(29), F.lit("0")).when(every(43), F.lit("91")).otherwise(text["latitude"]),
    }
    return m.select(*[text[c].alias(h) for c, h in zip(m.columns, SOURCE_HEADERS)])


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for clustering: the first two embedding components as degrees."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("restaurant_id"), F.col("label").alias("country_code"), F.lit("X").alias("city"),
        F.get("embedding", F.lit(0)).cast("double").alias("latitude"),
        F.get("embedding", F.lit(1)).cast("double").alias("longitude"),
    )


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (id, currency, cost), which have values beyond the fences."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("restaurant_id"), F.col("event_type").alias("currency"),
        F.col("value").alias("average_cost_for_two"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under their order's id: an id column that repeats."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("restaurant_id"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without their id, so that exact copies are equal rows."""
    return table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
