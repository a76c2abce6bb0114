"""Slices from the roll-up against the same figures from the listings; joins of bucketed tables."""

import random

import pytest
from pyspark.sql import functions as F

from venuegrid.operators import labels as label_questions
from venuegrid.operators import market, rollup, slicing
from venuegrid.plans.publish import Tables
from venuegrid.schema import LABEL_SCHEMA, LISTING_SCHEMA
from venuegrid.plans import buckets

COLUMNS = (
    "restaurant_id long, country_code int, currency string, city string, price_range int, aggregate_rating double, is_rated boolean, "
    "has_table_booking string, has_online_delivery string, votes long, cuisines string"
)
SLICES = [
    {}, {"countries": [1, 2]}, {"currencies": ["X"], "booking": "Yes"}, {"cities": ["A", "B"], "rating": (1.0, 5.0)},
    {"prices": [1], "delivery": "No"}, {"countries": [9]},
]


def some_listings(spark, n=400, ids=150, seed=3):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        rating = draw.choice([None, 0.0, 1.5, 3.2, 4.9])
        rows.append((
            draw.choice([None, 7, draw.randint(1, ids)]), draw.choice([None, 1, 2, 3]), draw.choice([None, "X", "Y"]), draw.choice([None, "A", "B", "C"]),
            draw.choice([None, 1, 2]), rating, None if rating is None else rating > 0, draw.choice(["Yes", "No", None]), draw.choice(["Yes", "No"]),
            draw.choice([None, 5, 100]), draw.choice([None, "Thai", "Thai, Pizza", "Tea"]),
        ))
    return spark.createDataFrame(rows, COLUMNS)


def lines(df, columns):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr,
    )


@pytest.fixture(scope="module")
def rolled(spark, tmp_path_factory):
    rows = some_listings(spark)
    return rows, rollup.write_rollup(rows, str(tmp_path_factory.mktemp("rollup")))


@pytest.mark.parametrize("choice", SLICES)
def test_slices_of_the_roll_up_equal_the_listings(rolled, choice):
    listings, cells = rolled
    part, mine = slicing.slice_listings(listings, **choice), rollup.slice_rollup(cells, **choice)
    summary = market.market_summary(part)
    assert lines(rollup.rollup_summary(mine), summary.columns) == lines(summary, summary.columns)
    for keys in (["city"], ["country_code", "currency"]):
        want = part.groupBy(*keys).agg(
            F.count("*").alias("listing_rows"), F.count_distinct("restaurant_id").alias("restaurants"), F.count_if("is_rated").alias("rated_restaurants"),
            F.sum("votes").alias("total_votes"), market.rated_mean().alias("average_rating"),
        )
        assert lines(rollup.rollup_counts(mine, keys), want.columns) == lines(want, want.columns)


def test_whole_roll_up_options_and_files(spark, rolled):
    listings, cells = rolled
    summary = market.market_summary(listings)
    found = rollup.rollup_summary(cells)
    assert lines(found, summary.columns) == lines(summary, summary.columns)
    assert all(f.rsplit("/", 2)[1] in rollup.SCHEMAS for f in found.inputFiles())
    assert cells.shared.groupBy("restaurant_id").count().where("count < 2").isEmpty() and cells.shared.where("restaurant_id = 7").count() > 50
    wide = listings.select(*listings.columns)
    exploded = wide.where("country_code = 1").select(F.explode(F.split("cuisines", ", ")).alias("cuisine")).distinct()
    options = {(r.filter_name, r.option_value) for r in rollup.rollup_option_lists(cells, countries=[1]).collect()}
    assert {v for k, v in options if k == "cuisine"} == {r.cuisine for r in exploded.collect()}
    assert {v for k, v in options if k == "country_code"} == {"1", "2", "3"}


def test_odd_requests_and_empty_listings(spark, rolled, tmp_path):
    _, cells = rolled
    with pytest.raises(ValueError, match="cuisine"):
        rollup.slice_rollup(cells, cuisines=["Thai"])
    with pytest.raises(ValueError, match="locality"):
        rollup.rollup_counts(cells, ["locality"])
    empty = rollup.write_rollup(spark.createDataFrame([], COLUMNS), str(tmp_path / "empty"))
    line = rollup.rollup_summary(empty).collect()
    assert [(r.restaurants, r.total_votes, r.average_rating, r.cuisines) for r in line] == [(0, 0, None, 0)]
    assert rollup.rollup_counts(empty, ["city"]).count() == 0


def _tables(spark):
    listings = some_listings(spark, 300, 60)
    for field in LISTING_SCHEMA:
        if field.name not in listings.columns:
            listings = listings.withColumn(field.name, F.lit(None).cast(field.dataType))
    listings = listings.withColumn("average_cost_for_two", (F.col("votes") * 3).cast("double"))
    labels = listings.withColumn("cuisine", F.explode(F.split("cuisines", ", ")))
    return Tables(listings.select(*LISTING_SCHEMA.names), labels.select(*LABEL_SCHEMA.names))


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    tables, path = _tables(spark), str(tmp_path / "buckets")
    written = buckets.write_bucketed(tables, path, 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = slicing.slice_labels(written.labels, written.listings)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, slicing.slice_labels(tables.labels, tables.listings).collect()))
        plan = label_questions.label_currency_join(written.labels, written.listings, 1)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("SortMergeJoin"):]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(map(repr, written.listings.collect())) == sorted(map(repr, tables.listings.collect()))


def test_bucketed_tables_open_in_another_session(spark, tmp_path):
    tables, path = _tables(spark), str(tmp_path / "again")
    count = buckets.write_bucketed(tables, path, 3).labels.count()
    for name in buckets.SCHEMAS:
        spark.sql(f"DROP TABLE {buckets._table(buckets._place(path, name, 3))}")
    assert buckets.load_bucketed(spark, path, 3).labels.count() == count
    with pytest.raises(FileNotFoundError, match="8 buckets"):
        buckets.load_bucketed(spark, path, 8)
