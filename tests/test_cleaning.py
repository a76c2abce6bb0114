"""Cleaning rules and derived features on small edge cases."""

import pytest
from pyspark.sql import functions as F

from venuegrid.functions import bins, text
from venuegrid.operators import cleaning, features
from venuegrid.schema import LISTING_SCHEMA, RAW_SCHEMA, SOURCE_HEADERS

GOOD = {
    "Restaurant ID": "7", "Restaurant Name": "Cafe", "Country Code": "1", "City": "A", "Cuisines": "Thai, Pizza",
    "Longitude": "10", "Latitude": "20", "Average Cost for two": "100", "Currency": "X", "Has Table booking": "No",
    "Has Online delivery": "No", "Is delivering now": "No", "Switch to order menu": "No", "Price range": "2",
    "Aggregate rating": "3.5", "Votes": "12",
}


def raw(spark, *changes):
    rows = [{**GOOD, "Restaurant ID": str(i), **c} for i, c in enumerate(changes, 1)]
    return spark.createDataFrame([tuple(r.get(h) for h in SOURCE_HEADERS) for r in rows], RAW_SCHEMA)


def column(frame, name, order="restaurant_id"):
    return [r[0] for r in frame.orderBy(order).select(name).collect()]


def test_names():
    assert text.snake_case("Average Cost for two") == "average_cost_for_two"
    assert text.snake_case("  Has--Table__booking! ") == "has_table_booking"


def test_text_is_stripped_and_blank_is_missing(spark):
    rows = raw(spark, {"City": "\t A 　"}, {"City": " \t "}, {"City": ""}, {"City": None}, {"City": "New York"})
    assert column(cleaning.standardise(rows), "city") == ["A", None, None, None, "New York"]


def test_flags_have_three_values(spark):
    rows = raw(spark, *[{"Has Table booking": v} for v in (" YES ", "no", "maybe", None)])
    assert column(cleaning.standardise(rows), "has_table_booking") == ["Yes", "No", None, None]


def test_numbers_parse_or_are_missing(spark):
    texts = [" 12 ", "1e2", "+3.5", "1d", "2F", "0x1p3", "NaN", "inf", "abc", "1,000", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = column(rows.withColumn("n", text.to_number(F.col("t"))), "n", "i")
    assert got == [12.0, 100.0, 3.5] + [None] * 9


def test_invalid_values_become_missing_and_the_row_stays(spark):
    bad = {"Aggregate rating": "5.5", "Price range": "0", "Votes": "-1", "Average Cost for two": "-1", "Latitude": "91"}
    row = cleaning.clean(raw(spark, bad)).collect()[0]
    for name in ("aggregate_rating", "price_range", "votes", "average_cost_for_two", "latitude"):
        assert row[name] is None
    assert row["longitude"] == 10.0 and row["is_rated"] is False and row["cost_category"] == "Unknown"


def test_a_fractional_price_band_is_out_of_domain(spark):
    rows = raw(spark, {"Price range": "2.5"}, {"Price range": "3.0"})
    assert column(cleaning.standardise(rows), "price_range") == [None, 3]


def test_coordinates(spark):
    rows = raw(
        spark, {"Longitude": "0", "Latitude": "0"}, {"Longitude": "0", "Latitude": "5"},
        {"Longitude": "181", "Latitude": "10"}, {"Longitude": None, "Latitude": "10"},
    )
    got = cleaning.standardise(rows)
    assert column(got, "longitude") == [None, 0.0, None, None]
    assert column(got, "latitude") == [None, 5.0, 10.0, 10.0]


def test_clean_has_the_whole_schema_and_every_row(spark):
    rows = raw(spark, {}, {"Cuisines": None}, {"Currency": None})
    got = cleaning.clean(rows)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in LISTING_SCHEMA]
    assert got.count() == 3


def test_rating_categories(spark):
    ratings = [0.0, 0.05, 2.9, 3.4, 3.9, 4.4, 5.0, None]
    rows = spark.createDataFrame(list(enumerate(ratings)), "i int, r double")
    got = column(rows.withColumn("c", bins.rating_category(F.col("r"))), "c", "i")
    assert got == ["Not rated", "Low", "Low", "Fair", "Good", "Very good", "Excellent", None]


def test_vote_categories(spark):
    rows = spark.createDataFrame(list(enumerate([0, 1, 10, 11, 100, 500, 501, None])), "i int, v long")
    got = column(rows.withColumn("c", bins.vote_category(F.col("v"))), "c", "i")
    assert got == ["No votes", "1-10", "1-10", "11-100", "11-100", "101-500", "501+", None]


def test_flags_are_never_missing(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.05), (3, 0.1), (4, 4.0)], "restaurant_id long, aggregate_rating double")
    got = features.with_rating_flags(rows).orderBy("restaurant_id").collect()
    assert [(r["is_rated"], r["is_low_rated"], r["is_high_rated"]) for r in got] == [
        (False, False, False), (True, False, False), (True, True, False), (True, False, True),
    ]


def test_labels(spark):
    rows = cleaning.standardise(raw(spark, {"Cuisines": " Thai ,, Pizza, "}, {"Cuisines": None}, {"Cuisines": ","}))
    assert column(features.with_label_count(rows), "cuisine_count") == [2, 0, 0]
    assert sorted(r["cuisine"] for r in features.explode_labels(rows).collect()) == ["Pizza", "Thai"]


def quarters(spark, costs, currency="X", leaf_rows=2_000_000):
    rows = [(i, c, currency) for i, c in enumerate(costs, 1)]
    frame = spark.createDataFrame(rows, "restaurant_id long, average_cost_for_two double, currency string")
    names = ["Low within currency", "Lower-middle within currency", "Upper-middle within currency", "High within currency"]
    got = column(features.with_cost_category(frame, leaf_rows), "cost_category")
    return [names.index(c) if c in names else c for c in got]


@pytest.mark.parametrize("n, want", [
    (1, ["Insufficient currency group"]), (2, [0, 3]), (3, [0, 1, 3]), (5, [0, 0, 1, 2, 3]), (6, [0, 0, 1, 2, 3, 3]),
])
def test_cost_quarters_of_small_groups(spark, n, want):
    assert quarters(spark, [float(v) for v in range(1, n + 1)]) == want


def test_cost_without_currency_or_without_value(spark):
    assert quarters(spark, [5.0, 6.0], currency=None) == ["Insufficient currency group"] * 2
    assert quarters(spark, [0.0, None, 3.0, 4.0]) == ["Unknown", "Unknown", 0, 3]


@pytest.mark.parametrize("leaf_rows", [2_000_000, 3])
def test_equal_costs_are_split_by_id(spark, leaf_rows):
    # Half of the rows share one cost, so all quarters end inside that run.
    costs = [1.0] * 4 + [2.0] * 30 + [3.0] * 5 + [2.0] * 11
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    n, want = len(costs), [0] * len(costs)
    for rank, i in enumerate(order):
        want[i] = max((4 * rank + n - 2) // (n - 1), 1) - 1
    assert quarters(spark, costs, leaf_rows=leaf_rows) == want


def test_cost_quarters_divide_equal_and_missing_ids(spark):
    from collections import Counter

    from venuegrid.operators import features

    rows = [(5, "X", 10.0)] * 8 + [(None, "Y", 7.0)] * 8 + [(k, "Z", 3.0) for k in range(8)]
    frame = spark.createDataFrame(rows, "restaurant_id long, currency string, average_cost_for_two double")
    found = Counter((r.currency, r.cost_category) for r in features.with_cost_category(frame).collect())
    assert len(found) == 12 and set(found.values()) == {2}


def test_numbers_beyond_the_doubles_are_missing(spark):
    from venuegrid.functions.text import to_number

    frame = spark.createDataFrame([("1e999",), ("-1e999",), ("12.5",), ("1d",), (None,)], "x string")
    assert [r.x for r in frame.select(to_number(F.col("x")).alias("x")).collect()] == [None, None, 12.5, None, None]
