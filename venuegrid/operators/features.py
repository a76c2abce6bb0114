"""Derived listing features and the exploded label table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.functions import bins
from venuegrid.functions.ranks import LEAF_ROWS, numbered, order_statistics, value_ranks
from venuegrid.functions.text import label_array, label_count
from venuegrid.schema import COST_CATEGORIES, COST_TOO_FEW, COST_UNKNOWN, LABEL_SCHEMA
from venuegrid.session import settle


def with_label_count(df: DataFrame) -> DataFrame:
    return df.withColumn("cuisine_count", label_count(F.col("cuisines")))


def with_rating_flags(df: DataFrame) -> DataFrame:
    r = F.col("aggregate_rating")
    return df.withColumns({
        "is_rated": bins.truth(r > 0),
        "is_high_rated": bins.truth(r >= 4.0),
        "is_low_rated": bins.truth(r.between(0.1, 2.9)),
    })


def with_price_flags(df: DataFrame) -> DataFrame:
    p = F.col("price_range")
    return df.withColumns({"is_affordable": bins.truth(p == 1), "is_expensive": bins.truth(p == 4)})


def with_service_flags(df: DataFrame) -> DataFrame:
    booking, delivery = F.col("has_table_booking"), F.col("has_online_delivery")
    now, menu = F.col("is_delivering_now"), F.col("switch_to_order_menu")
    return df.withColumns({
        "has_digital_service": bins.any_yes(delivery, now, menu),
        "has_booking_or_delivery": bins.any_yes(booking, delivery),
    })


def with_rating_category(df: DataFrame) -> DataFrame:
    return df.withColumn("rating_category", bins.rating_category(F.col("aggregate_rating")))


def with_vote_category(df: DataFrame) -> DataFrame:
    return df.withColumn("vote_category", bins.vote_category(F.col("votes")))


# A missing id is the last one of its price.
def _row_id() -> Column:
    return F.coalesce(F.col("restaurant_id").cast("bigint"), F.lit(2**63 - 1))


def _cost_cuts(df: DataFrame, leaf_rows: int) -> DataFrame:
    """Per currency the last (cost, id) of each of the first three quarters.

    Ranking 1..n by cost, then id, a quarter ends at rank 1 + (n - 1) * q / 4.
    Only the cost at that rank is searched; ids matter just where a quarter ends
    inside a run of equal costs. Ids may repeat: ``take`` of the ``same`` rows with
    the last cost and id belong to the quarter.
    """
    priced = df.where((F.col("average_cost_for_two") > 0) & F.col("currency").isNotNull())
    priced = settle(priced.select("currency", F.col("average_cost_for_two").alias("cost"), _row_id().alias("id")), "priced")
    ends = order_statistics(
        priced, ["currency"], "cost",
        lambda n: F.array(*[F.floor((n - 1) * F.lit(q) / F.lit(4)).cast("bigint") for q in (1, 2, 3)]),
        leaf_rows,
    )
    ends = settle(ends.withColumn("place", F.col("rank") - F.col("below")), "cuts")

    # Runs of equal costs that a quarter ends in: find the id at that place of the run.
    inside = ends.where(F.col("place") < F.col("equal") - 1).select("currency", F.col("value").alias("cost"), "place")
    if inside.head(1):
        tied = priced.join(inside.distinct(), ["currency", "cost"])
        ids = order_statistics(tied, ["currency", "cost", "place"], "id", lambda n: F.array("place"), leaf_rows).select(
            "currency", F.col("cost").alias("value"), "place", F.col("value").alias("last_id"),
            (F.col("place") - F.col("below") + 1).alias("take"), F.col("equal").alias("same"),
        )
        full = ends.join(ids, ["currency", "value", "place"], "left")
    else:
        none = F.lit(None).cast("bigint")
        full = ends.withColumns({"last_id": none, "take": none, "same": none})
    quarter = [F.floor((F.col("total") - 1) * F.lit(q) / F.lit(4)) for q in (1, 2, 3)]
    picked = [F.max(F.when(F.col("rank") == k, F.struct("value", "last_id", "take", "same"))) for k in quarter]
    return full.groupBy("currency").agg(
        F.max("total").alias("_priced"), *[p.alias(f"_cut{q}") for q, p in enumerate(picked, 1)]
    )


def _with_turn(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """``df`` with ``_turn``: among rows of equal currency, cost and id that a quarter divides, 1, 2, 3, ...; else 1."""
    ends = cuts.select("currency", F.explode(F.array("_cut1", "_cut2", "_cut3")).alias("c")).where("c.take < c.same")
    ends = settle(ends.select("currency", F.col("c.value").alias("_cost"), F.col("c.last_id").alias("_id")).distinct(), "divided")
    if not ends.head(1):
        return df.withColumn("_turn", F.lit(1).cast("bigint"))
    key = (F.col("_of") == F.col("currency")) & (F.col("_cost") == F.col("average_cost_for_two")) & (F.col("_id") == _row_id())
    ends = ends.withColumnRenamed("currency", "_of")
    divided = settle(df.join(ends, key).withColumn("_row", F.monotonically_increasing_id()), "divided")
    divided = numbered(divided, ["_of", "_cost", "_id", "_row"], "_turn")
    first = divided.groupBy("_of", "_cost", "_id").agg(F.min("_turn").alias("_least"))
    divided = divided.join(first, ["_of", "_cost", "_id"]).withColumn("_turn", F.col("_turn") - F.col("_least") + 1)
    rest = df.join(ends, key, "left_anti").withColumn("_turn", F.lit(1).cast("bigint"))
    return rest.unionByName(divided.select(*rest.columns))


def with_cost_category(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Quarter of the listing's cost inside its currency, ties split by id, and equal ids in any order.

    The rows themselves are not ranked or shuffled: each is compared with the
    three cut points of its currency.
    """
    cuts = settle(_cost_cuts(df, leaf_rows), "cuts")
    cost = F.col("average_cost_for_two")

    def beyond(cut: str) -> Column:
        value, last_id = F.col(f"{cut}.value"), F.col(f"{cut}.last_id")
        after = (_row_id() > last_id) | ((_row_id() == last_id) & (F.col("_turn") > F.col(f"{cut}.take")))
        return bins.truth((cost > value) | ((cost == value) & after)).cast("int")

    quarter = beyond("_cut1") + beyond("_cut2") + beyond("_cut3")
    names = F.array(*[F.lit(c) for c in COST_CATEGORIES])
    category = (
        F.when(~bins.truth(cost > 0), COST_UNKNOWN)
        .when(F.coalesce(F.col("_priced"), F.lit(0)) < 2, COST_TOO_FEW)
        .otherwise(F.get(names, quarter))
    )
    joined = _with_turn(df, cuts).join(cuts, "currency", "left").withColumn("cost_category", category)
    return joined.select(*df.columns, "cost_category")


def add_features(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The eleven derived columns, after the source columns."""
    return (
        df.transform(with_label_count)
        .transform(with_rating_flags)
        .transform(with_price_flags)
        .transform(with_service_flags)
        .transform(with_rating_category)
        .transform(with_vote_category)
        .transform(with_cost_category, leaf_rows)
    )


def explode_labels(df: DataFrame) -> DataFrame:
    """One row per listing and label; listings without a label give no row."""
    carried = [f.name for f in LABEL_SCHEMA if f.name != "cuisine"]
    return df.select(*carried, F.explode(label_array(F.col("cuisines"))).alias("cuisine"))


def cost_percentile(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rated listings with the average-rank percentile of their cost in the currency.

    Ranks are over all priced listings; the rated filter comes after.
    """
    priced = df.where((F.col("average_cost_for_two") > 0) & F.col("currency").isNotNull())
    ranks = value_ranks(priced, ["currency"], "average_cost_for_two", leaf_rows=leaf_rows)
    percentile = (F.col("below") + (F.col("equal") + 1) / F.lit(2.0)) / F.col("total")
    ranks = ranks.select("currency", "average_cost_for_two", percentile.alias("cost_percentile"))
    rated = priced.where("is_rated").select(
        "restaurant_id", "restaurant_name", "currency", "average_cost_for_two",
        "price_range", "aggregate_rating",
    )
    # Both keys are present here. A price that very many listings share is one
    # line on the right, so adaptive execution can split it on the left.
    return rated.join(ranks, ["currency", "average_cost_for_two"])


def relabel_flag(
    df: DataFrame, flag: str = "has_online_delivery", yes: str = "Online delivery", no: str = "No online delivery"
) -> DataFrame:
    """Rated listings with the flag spelled out for display."""
    words = F.when(F.col(flag) == "Yes", yes).when(F.col(flag) == "No", no)
    return df.where("is_rated").withColumn("digital_services", words)
