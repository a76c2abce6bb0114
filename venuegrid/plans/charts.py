"""The tables behind the charts, from one pass over the listings and one over the label rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.ranks import LEAF_ROWS, quantiles, value_ranks
from venuegrid.functions.spread import spread
from venuegrid.schema import PRICE_BANDS, RATING_CATEGORIES
from venuegrid.session import settle

LINE = {"chart": "string", "label": "string", "series": "string", "x": "double", "y": "double", "z": "double", "restaurants": "bigint"}
#: Lengths and thresholds of the charts.
TOP, HEAT, LABEL_LEAST, CITY_LEAST, COST_LEAST, PANELS = 15, 12, 50, 30, 10, 6
_FLAGS = {"online_delivery_adoption": "has_online_delivery", "table_booking_adoption": "has_table_booking"}
_SERVICE = {"Yes": "Online delivery", "No": "No online delivery"}


def chart_lines(
    listings: DataFrame, labels: DataFrame, *, label_least: int = LABEL_LEAST, city_least: int = CITY_LEAST, cost_least: int = COST_LEAST,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(chart, label, series, x, y, z, restaurants): all charts' numbers as long lines.

    Bars have a label and ``restaurants`` or ``y``, panels and heat maps a series too.
    Points with equal coordinates are one line with their number of listings: votes and
    rating, cost percentile and rating by price band, longitude, latitude and rating.
    Box plots have a line for each statistic. Pairs of the heat map that do not occur have no line.
    """
    cells, named = settle(_cells(listings), "chart-cells"), settle(_label_cells(labels), "chart-labels")

    def of(chart: str) -> DataFrame:
        return cells.where(F.col("chart") == chart)

    city = of("restaurants_by_city").where("label is not null")
    parts = [
        _top(city, TOP), of("restaurants_by_country").where("label is not null"),
        _all_of(cells, "price_range_distribution", [str(b) for b in PRICE_BANDS]), _all_of(cells, "rating_distribution", RATING_CATEGORIES),
        *(_all_of(cells, chart, ["Yes", "No"]) for chart in _FLAGS),
        _best(_means(of("average_rating_by_city"), "label"), city_least), _panels(_means(of("cost_by_city_currency"), "label", "series"), cost_least),
        of("votes_vs_rating"), of("geographic_distribution"), _relative(of("relative_cost_vs_rating"), leaf_rows), _boxes(of("rating_by_digital_services"), leaf_rows),
    ]
    counts = named.groupBy("cuisine").agg(F.sum("listing").alias("restaurants"), F.sum("n").alias("n"))
    rated = named.where("rated > 0").groupBy("cuisine").agg(F.sum("listing").alias("restaurants"), (F.sum("total") / F.sum("rated")).alias("y"))
    leading = counts.orderBy(F.desc("n"), "cuisine").limit(HEAT).select("cuisine")
    cities = _top(city, HEAT).select(F.col("label").alias("city"))
    heat = named.join(leading, "cuisine", "left_semi").join(cities, "city", "left_semi").groupBy("city", "cuisine").agg(F.count("id").alias("restaurants"))

    def label(chart: str, df: DataFrame) -> DataFrame:
        return df.withColumn("chart", F.lit(chart))

    parts += [
        label("top_cuisines", _top(counts.select(F.col("cuisine").alias("label"), "restaurants"), TOP)),
        label("average_rating_by_cuisine", _best(rated.withColumnRenamed("cuisine", "label"), label_least)),
        label("cuisine_by_city_heatmap", heat.withColumnsRenamed({"city": "label", "cuisine": "series"})),
    ]
    return reduce(DataFrame.unionByName, [_lines(p) for p in parts])


def _lines(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in LINE.items()])


def _cells(listings: DataFrame) -> DataFrame:
    """What the charts count, group by group, with equal rows added up; ``id`` only where listings count once."""
    def cell(chart: str, where: Column | None = None, **held: Column) -> Column:
        kinds = {"label": "string", "series": "string", "x": "double", "y": "double", "z": "double", "id": "bigint", "m": "double"}
        made = F.struct(F.lit(chart).alias("chart"), *[held.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        return made if where is None else F.when(where, made)

    city, currency, cost, rating, rated, key = (
        F.col(c) for c in ("city", "currency", "average_cost_for_two", "aggregate_rating", "is_rated", "restaurant_id")
    )
    lon, lat, delivery = F.col("longitude"), F.col("latitude"), F.col("has_online_delivery")
    service = F.when(delivery == "Yes", _SERVICE["Yes"]).when(delivery == "No", _SERVICE["No"])
    cells = [
        cell("restaurants_by_city", label=city), cell("restaurants_by_country", label=F.col("country_code")),
        cell("price_range_distribution", label=F.col("price_range")), cell("rating_distribution", label=F.col("rating_category")),
        *(cell(chart, label=F.col(flag)) for chart, flag in _FLAGS.items()),
        cell("average_rating_by_city", rated & city.isNotNull(), label=city, id=key, m=rating),
        cell("cost_by_city_currency", (cost > 0) & city.isNotNull() & currency.isNotNull(), label=city, series=currency, id=key, m=cost),
        cell("votes_vs_rating", rated, x=F.col("votes"), y=rating),
        cell("geographic_distribution", lon.isNotNull() & lat.isNotNull(), x=lon, y=lat, z=rating),
        cell("relative_cost_vs_rating", (cost > 0) & currency.isNotNull(), label=F.col("price_range"), series=currency, x=cost, y=rating, z=rated.cast("int")),
        cell("rating_by_digital_services", rated & service.isNotNull() & rating.isNotNull(), label=service, y=rating),
    ]
    held = listings.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
    return held.groupBy("chart", "label", "series", "x", "y", "z", "id").agg(F.count("*").alias("restaurants"), F.sum("m").alias("total"))


def _label_cells(labels: DataFrame) -> DataFrame:
    """A line for each label, city and listing; ``listing`` is 1 on one line of each label and listing, a rated one if there is any."""
    rating = F.col("aggregate_rating")
    rows = spread(labels.select("cuisine", "city", F.col("restaurant_id").alias("id"), "aggregate_rating"), labels.count(), "cuisine", "id")
    cells = rows.groupBy("cuisine", "city", "id").agg(
        F.count("*").alias("n"), F.count_if(rating > 0).alias("rated"), F.sum(F.when(rating > 0, rating)).alias("total"),
    )
    lead = F.row_number().over(Window.partitionBy("cuisine", "id").orderBy(F.desc(F.col("rated") > 0), "city")) == 1
    return cells.withColumn("listing", (lead & F.col("id").isNotNull()).cast("int"))


def _top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("restaurants"), "label").limit(k)


def _best(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("restaurants") >= least).orderBy(F.desc("y"), "label").limit(TOP)


def _all_of(cells: DataFrame, chart: str, order: list[str]) -> DataFrame:
    """A line for each of the given labels, zero where none occurs."""
    counts = cells.where(F.col("chart") == chart).groupBy("label").agg(F.sum("restaurants").alias("restaurants"))
    fixed = cells.sparkSession.createDataFrame([(chart, name) for name in order], "chart string, label string")
    return fixed.join(counts, "label", "left").select("chart", "label", F.coalesce("restaurants", F.lit(0)).alias("restaurants"))


def _means(df: DataFrame, *keys: str) -> DataFrame:
    """Mean and distinct listings of each group, from sums by listing: a group has one line for each of its listings."""
    return df.groupBy("chart", *keys).agg((F.sum("total") / F.sum("restaurants")).alias("y"), F.count("id").alias("restaurants"))


def _panels(df: DataFrame, least: int) -> DataFrame:
    kept = df.where(F.col("restaurants") >= least)
    leading = kept.groupBy("series").agg(F.sum("restaurants").alias("n")).orderBy(F.desc("n"), "series").limit(PANELS)
    return kept.join(leading.select("series"), "series", "left_semi")


def _relative(df: DataFrame, leaf_rows: int) -> DataFrame:
    """Average-rank percentile of each cost in its currency over all priced listings, then the rated ones."""
    ranks = value_ranks(df, ["series"], "x", "restaurants", leaf_rows)
    share = (F.col("below") + (F.col("equal") + 1) / F.lit(2.0)) / F.col("total")
    points = null_safe_join(df.where("z = 1").select("chart", "label", "series", "x", "y", "restaurants"), ranks.select("series", "x", share.alias("_share")), ["series", "x"])
    return points.groupBy("chart", F.col("label").alias("series"), F.col("_share").alias("x"), "y").agg(F.sum("restaurants").alias("restaurants"))


def _boxes(df: DataFrame, leaf_rows: int) -> DataFrame:
    """Quartiles, whiskers (outermost ratings within 1.5 quartile ranges), rated listings and outliers of each label."""
    box = quantiles(df, ["label"], "y", {"q1": 0.25, "median": 0.5, "q3": 0.75}, leaf_rows, "restaurants").drop("n")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    within, n = F.col("y").between(F.col("q1") - spread, F.col("q3") + spread), F.col("restaurants")
    stats = df.join(box, "label").groupBy("chart", "label", "q1", "median", "q3").agg(
        F.min(F.when(within, F.col("y"))).alias("whisker_low"), F.max(F.when(within, F.col("y"))).alias("whisker_high"),
        F.sum(n).alias("rated"), F.sum(F.when(within, 0).otherwise(n)).alias("outliers"),
    )
    none_x, none_n = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    lines = [F.struct(F.lit(c).alias("series"), F.col(c).alias("y"), none_n.alias("restaurants")) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")]
    lines += [F.struct(F.lit(c).alias("series"), none_x.alias("y"), F.col(c).alias("restaurants")) for c in ("rated", "outliers")]
    return stats.select("chart", "label", F.explode(F.array(*lines)).alias("l")).select("chart", "label", "l.*")
