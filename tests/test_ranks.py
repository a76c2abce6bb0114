"""Distributed ranks and quantiles against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from venuegrid.functions.ranks import order_statistics, quantiles, value_ranks

PROBS = {"q1": 0.25, "q5": 0.5, "q99": 0.99}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({
        "g": rng.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1]),
        "x": np.round(rng.lognormal(3, 2, 3000), 2),
    })
    rows.loc[rng.random(3000) < 0.33, "x"] = 7.0  # one value holds a third of the rows
    rows.loc[rng.random(3000) < 0.05, "x"] = -3.5
    rows.loc[rng.random(3000) < 0.05, "x"] = 0.0
    return rows


@pytest.mark.parametrize("leaf_rows", [2_000_000, 15])
def test_quantiles_equal_pandas(spark, values, leaf_rows):
    got = quantiles(spark.createDataFrame(values), ["g"], "x", PROBS, leaf_rows).toPandas()
    want = values.groupby("g", dropna=False)["x"].quantile(list(PROBS.values())).unstack()
    for _, row in got.iterrows():
        key = row["g"] if isinstance(row["g"], str) else np.nan
        line = want.loc[key] if isinstance(key, str) else want[want.index.isna()].iloc[0]
        assert [row[n] for n in PROBS] == pytest.approx(line.tolist(), rel=1e-14)


@pytest.mark.parametrize("leaf_rows", [2_000_000, 15])
def test_average_ranks_equal_pandas(spark, values, leaf_rows):
    got = value_ranks(spark.createDataFrame(values), ["g"], "x", leaf_rows=leaf_rows).toPandas()
    got["rank"] = got["below"] + (got["equal"] + 1) / 2
    want = values.assign(rank=values.groupby("g", dropna=False)["x"].rank()).drop_duplicates(["g", "x"])
    both = want.merge(got, on=["g", "x"])
    assert len(both) == len(want) == len(got)
    assert (both["rank_x"] == both["rank_y"]).all()


def test_weighted_ranks_count_copies(spark):
    rows = spark.createDataFrame([(1.0, 2), (2.0, 3), (5.0, 1)], "x double, w long")
    got = {r["x"]: (r["below"], r["equal"], r["total"]) for r in value_ranks(rows, [], "x", "w").collect()}
    assert got == {1.0: (0, 2, 6), 2.0: (2, 3, 6), 5.0: (5, 1, 6)}


def test_tied_ranks_give_the_documented_percentiles(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 4.0)], "x double")
    got = value_ranks(rows, [], "x").select(
        "x", ((F.col("below") + (F.col("equal") + 1) / 2) / F.col("total")).alias("p")
    )
    assert dict(got.collect()) == {1.0: 0.25, 2.0: 0.625, 4.0: 1.0}


def test_large_whole_numbers_keep_their_last_digit(spark):
    start = 9_007_199_254_740_992  # neighbours collide as doubles
    rows = spark.range(start, start + 400)
    got = order_statistics(rows, [], "id", lambda n: F.array(F.lit(0), F.lit(201), n - 1), leaf_rows=5)
    assert sorted(r["value"] - start for r in got.collect()) == [0, 201, 399]


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert quantiles(none, ["g"], "x", PROBS).columns == ["g", "n", "q1", "q5", "q99"]
    assert quantiles(none, ["g"], "x", PROBS).count() == 0
    assert value_ranks(none, ["g"], "x").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_any_quantile(spark, numbers, p):
    rows = spark.createDataFrame([(float(v),) for v in numbers], "x double")
    got = quantiles(rows, [], "x", {"q": p}, leaf_rows=4).collect()[0]
    want = float(np.quantile(numbers, p))
    assert got["n"] == len(numbers)
    assert math.isclose(got["q"], want, rel_tol=1e-9, abs_tol=1e-9)


def test_many_values_are_ranked_range_by_range(spark, monkeypatch):
    from venuegrid.functions import ranks

    written, write = {}, ranks.settle

    def noted(frame, name):
        written[name] = write(frame, name)
        return written[name]

    monkeypatch.setattr(ranks, "settle", noted)
    close = [(1000.0 + k * 1e-9,) for k in range(3000)] + [(1040.0,), (1000.05,), (float("inf"),), (float("-inf"),), (1e308,)] * 2
    rows = value_ranks(spark.createDataFrame(close, "x double"), [], "x", leaf_rows=100).collect()
    ordered = sorted(x for x, in close)
    assert {r["x"]: (r["below"], r["equal"], r["total"]) for r in rows} == {x: (ordered.index(x), ordered.count(x), len(close)) for x in set(ordered)}
    largest = written["ranges"].groupBy("_part").count().agg(F.max("count")).head()[0]
    assert largest < 0.6 * len(set(ordered))


def test_rows_are_counted_before_they_are_sorted(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("x"))
    lines, _ = __import__("venuegrid.functions.ranks", fromlist=["_counted"])._counted(rows, [], "x", None)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "Sort" not in plan
    assert quantiles(spark.createDataFrame([(1.0, 3), (9.0, 1)], "x double, w long"), [], "x", {"q": 0.5}, weight="w").head()["q"] == 1.0
