"""A task's share, and what is shuffled and stored, must not grow faster than the tables."""

import re

from pyspark.sql import functions as F

from venuegrid.functions import spread as spreading
from venuegrid.operators import labels, statistics
from venuegrid.plans import buckets
from venuegrid.plans.publish import Tables
from verification import bindings, catalog


def counted(monkeypatch, task_rows):
    monkeypatch.setattr(spreading.tasks_for, "__defaults__", (task_rows,))


def text_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def label_rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("restaurant_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("cuisine"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 50) / 10).alias("aggregate_rating"), (F.col("id") % 90).alias("votes"),
    )


def test_tasks_follow_the_rows():
    assert [spreading.tasks_for(rows, 8, 100) for rows in (0, 800, 801, 100_000)] == [8, 8, 9, 1000]


def test_labels_are_dealt_out_by_their_number(spark, monkeypatch):
    rows = label_rows(spark, 4_000)
    plain = rows.groupBy("cuisine").agg(F.count_distinct("restaurant_id").alias("n"), F.sum("votes").alias("v")).collect()
    counted(monkeypatch, 100)
    for operator in (labels.label_rating, labels.top_labels, labels.label_rating_topk):
        assert re.search(r"hashpartitioning\(cuisine#\d+, restaurant_id#\d+L, 40\)", text_of(operator(rows)))
    got = labels.label_rating(rows, 1).collect()
    assert sorted(map(str, [(r.cuisine, r.restaurants, r.associated_votes) for r in got])) == sorted(map(str, [(r.cuisine, r.n, r.v) for r in plain]))


def test_the_label_join_deals_out_both_tables(spark, monkeypatch):
    counted(monkeypatch, 100)
    rows = label_rows(spark, 2_000)
    listings = rows.select("restaurant_id", F.lit("X").alias("currency"), "aggregate_rating", (F.col("aggregate_rating") > 0).alias("is_rated"), F.lit(2.0).alias("average_cost_for_two"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = labels.label_currency_join(rows, listings, 1, rows=2_000)
        plan = text_of(joined)
        assert len(re.findall(r"hashpartitioning\(restaurant_id#\d+L, 20\)", plan)) == 2
        both = [found.withColumn("average_rating", F.round("average_rating", 9)).collect() for found in (joined, labels.label_currency_join(rows, listings, 1))]
        assert sorted(map(str, both[0])) == sorted(map(str, both[1]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_buckets_follow_the_label_rows(spark, folder, monkeypatch):
    tables = Tables(spark.range(10), spark.range(95))
    counted(monkeypatch, 10)
    assert buckets.buckets_for(tables, 8) == 10 and buckets.buckets_for(tables, 12) == 12
    counted(monkeypatch, 5_000)
    made = []
    monkeypatch.setattr(catalog.buckets, "write_bucketed", lambda tables, path, n: made.append(n) or tables)
    catalog._bucketed(spark, folder)
    assert made == [max(8, -(-bindings.listing_tables(spark, folder).labels.count() // 5_000))]


def test_correlations_store_a_line_for_each_listing(spark, monkeypatch):
    """Not one for each family that a listing belongs to."""
    rows = spark.range(200).select(
        (F.col("id") * 3).alias("votes"), (1 + F.col("id") % 40 / 10).alias("aggregate_rating"), F.lit("X").alias("currency"),
        (F.col("id") + 0.25).alias("average_cost_for_two"), F.lit(True).alias("is_rated"),
    )
    stored, write = [], statistics.settle
    monkeypatch.setattr(statistics, "settle", lambda frame, name: stored.append(frame) or write(frame, name))
    lines = statistics.rank_correlations(rows).collect()
    assert [frame.count() for frame in stored] == [200]
    assert {(r.variable_x, r.variable_y, r.n) for r in lines} == {(*family, 200) for family in statistics.FAMILIES}


def test_lines_are_dealt_out_before_their_names_are_gathered(spark, folder):
    plan = bindings._orders(spark, folder)._jdf.queryExecution().executedPlan().toString()
    gathered = [k for k, line in enumerate(plan.splitlines()) if "collect_set" in line]
    dealt = next(k for k, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning(l_orderkey" in line)
    assert gathered and max(gathered) < dealt  # a plan reads from the last step to the first
    assert "n_name" not in plan


def test_charts_count_listings_without_distinct_counts(spark, tmp_path):
    """A listing that repeats, changes its city or has no id counts once, several times and never."""
    from venuegrid.plans import charts

    rows = [("a", "x", 1, 4.0), ("a", "x", 1, 4.0), ("a", "y", 1, 0.0), ("a", "y", 2, 0.0), ("a", "x", None, 3.0), ("a", None, 3, 1.0), ("b", "x", 1, None)]
    labels_ = spark.createDataFrame(rows * 2, "cuisine string, city string, restaurant_id long, aggregate_rating double")
    cells = charts._label_cells(labels_)
    assert not re.search(r"Exchange.*\n.*Window", text_of(cells))
    per = {r.cuisine: (r.n, r.rated) for r in cells.groupBy("cuisine").agg(
        F.sum("listing").alias("n"), F.sum(F.when(F.col("rated") > 0, F.col("listing"))).alias("rated")).collect()}
    want = {r.cuisine: (r.n, r.rated) for r in labels_.groupBy("cuisine").agg(
        F.count_distinct("restaurant_id").alias("n"),
        F.count_distinct(F.when(F.col("aggregate_rating") > 0, F.col("restaurant_id"))).alias("rated")).collect()}
    assert per["a"] == want["a"] == (3, 2) and per["b"][0] == want["b"][0] == 1
    listings = spark.range(60).select(
        (F.col("id") % 20).alias("restaurant_id"), F.lit(1).alias("country_code"), F.concat(F.lit("t"), F.col("id") % 3).alias("city"), F.lit(1.0).alias("longitude"),
        F.lit(2.0).alias("latitude"), F.lit(5.0).alias("average_cost_for_two"), F.lit("X").alias("currency"), F.lit("Yes").alias("has_table_booking"),
        F.lit("No").alias("has_online_delivery"), F.lit(2).alias("price_range"), F.lit(3.0).alias("aggregate_rating"), F.lit(7).cast("bigint").alias("votes"),
        F.lit(True).alias("is_rated"), F.lit("Good").alias("rating_category"),
    )
    lines = charts.chart_lines(listings, labels_, label_least=1, city_least=1, cost_least=1)
    assert "count(distinct" not in lines._jdf.queryExecution().analyzed().toString()
    held = {r.label: r.restaurants for r in lines.where("chart = 'average_rating_by_city'").collect()}
    assert held == {r.city: r.n for r in listings.groupBy("city").agg(F.count_distinct("restaurant_id").alias("n")).collect()}
