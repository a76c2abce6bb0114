"""Test statistics and p-values against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest

from venuegrid.functions import distributions
from venuegrid.operators import statistics


def listings(spark, rng, n=400):
    rating = np.round(rng.uniform(0, 5, n), 1)
    rows = pd.DataFrame({
        "currency": rng.choice(["a", "b", None], n), "average_cost_for_two": np.round(rng.uniform(0, 50, n)),
        "votes": rng.integers(0, 30, n), "aggregate_rating": rating, "price_range": rng.integers(1, 5, n),
        "has_online_delivery": rng.choice(["Yes", "No", None], n), "has_table_booking": rng.choice(["Yes", "No"], n),
        "is_rated": rating > 0,
    })
    return rows, spark.createDataFrame(rows)


@pytest.fixture(scope="module")
def data(spark):
    return listings(spark, np.random.default_rng(3))


def integral(f, a, b, steps=200_001):
    x = np.linspace(a, b, steps)
    return float(np.trapezoid(f(x), x))


@pytest.mark.parametrize("t, df", [(0.3, 5), (2.1, 3.7), (-4.0, 60.2), (9.9, 1500.0)])
def test_t_tail(t, df):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    inside = integral(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), -abs(t), abs(t))
    assert distributions.t_two_sided(t, df) == pytest.approx(1 - inside, abs=1e-8)


@pytest.mark.parametrize("x, df", [(0.5, 3), (7.8, 3), (30.0, 2), (3.0, 10)])
def test_chi_square_tail(x, df):
    c = 1 / (2 ** (df / 2) * math.gamma(df / 2))
    inside = integral(lambda v: c * v ** (df / 2 - 1) * np.exp(-v / 2), 1e-12, x)
    assert distributions.chi2_tail(x, df) == pytest.approx(1 - inside, abs=1e-6)


def test_far_tails_do_not_round_to_zero():
    assert 0 < distributions.t_two_sided(60.0, 7000) < 1e-300 or distributions.t_two_sided(60.0, 7000) == 0.0
    assert distributions.chi2_tail(1326.067, 3) == pytest.approx(3.3e-287, rel=0.1)
    assert math.isnan(distributions.t_two_sided(1.0, 0))


def test_spearman(spark, data):
    rows, frame = data
    got = {(r["currency"], r["variable_y"]): r for r in statistics.spearman(frame, leaf_rows=10).collect()}
    rated = rows[rows.is_rated]
    want = {("All currencies", "aggregate_rating"): rated[["votes", "aggregate_rating"]]}
    for c in ("a", "b"):
        costs = rows[(rows.currency == c) & (rows.average_cost_for_two > 0)]
        want[c, "aggregate_rating"] = costs[costs.is_rated][["average_cost_for_two", "aggregate_rating"]]
        want[c, "votes"] = costs[["average_cost_for_two", "votes"]]
    assert set(got) == set(want)
    for key, pair in want.items():
        rho = np.corrcoef(pair.rank().to_numpy().T)[0, 1]
        t = rho * math.sqrt((len(pair) - 2) / ((1 + rho) * (1 - rho)))
        assert got[key]["n"] == len(pair)
        assert got[key]["statistic"] == pytest.approx(rho, abs=1e-12)
        assert got[key]["p_value"] == pytest.approx(distributions.t_two_sided(t, len(pair) - 2), rel=1e-9)


def test_welch(spark, data):
    rows, frame = data
    got = {r["variable"]: r for r in statistics.welch_t(frame).collect()}
    for flag in ("has_online_delivery", "has_table_booking"):
        x, y = (rows[rows.is_rated & (rows[flag] == v)].aggregate_rating for v in ("Yes", "No"))
        e1, e2 = x.var() / len(x), y.var() / len(y)
        df = (e1 + e2) ** 2 / (e1**2 / (len(x) - 1) + e2**2 / (len(y) - 1))
        t = (x.mean() - y.mean()) / math.sqrt(e1 + e2)
        line = got[flag]
        assert (line["n_yes"], line["n_no"]) == (len(x), len(y))
        assert line["statistic"] == pytest.approx(t, rel=1e-9)
        assert line["p_value"] == pytest.approx(distributions.t_two_sided(t, df), rel=1e-8)


def test_kruskal(spark, data):
    rows, frame = data
    rated = rows[rows.is_rated]
    rank, n = rated.aggregate_rating.rank(), len(rated)
    h = 12 / (n * (n + 1)) * sum(g.sum() ** 2 / len(g) for _, g in rank.groupby(rated.price_range)) - 3 * (n + 1)
    ties = sum(k**3 - k for k in rated.aggregate_rating.value_counts())
    h /= 1 - ties / (n**3 - n)
    line = statistics.kruskal(frame).collect()[0]
    assert (line["n_yes"], line["statistic"]) == (n, pytest.approx(h, rel=1e-9))
    assert line["p_value"] == pytest.approx(distributions.chi2_tail(h, 3), rel=1e-9)


def test_constant_ratings_and_small_groups_give_missing_statistics(spark):
    rows = [(i, "a", 10.0 + i, i, 4.0, 1 + i % 2, "Yes" if i == 1 else "No", "No", True) for i in range(1, 7)]
    frame = spark.createDataFrame(rows, """restaurant_id long, currency string, average_cost_for_two double, votes long,
        aggregate_rating double, price_range int, has_online_delivery string, has_table_booking string, is_rated boolean""")
    spearman = statistics.spearman(frame).where("variable_y = 'aggregate_rating'").collect()
    assert [(r["n"], r["statistic"], r["p_value"]) for r in spearman] == [(6, None, None)] * 2
    perfect = statistics.spearman(frame).where("variable_y = 'votes'").collect()[0]
    assert (perfect["statistic"], perfect["p_value"]) == (pytest.approx(1.0), 0.0)
    welch = {r["variable"]: r for r in statistics.welch_t(frame).collect()}
    assert welch["has_online_delivery"]["mean_yes"] == 4.0 and welch["has_online_delivery"]["statistic"] is None
    assert welch["has_table_booking"]["n_yes"] == 0 and welch["has_table_booking"]["mean_yes"] is None
    assert statistics.kruskal(frame).collect()[0]["statistic"] is None
    assert statistics.kruskal(frame.where("price_range = 1")).count() == 0


def test_report_has_all_lines_in_order_of_p(spark, data):
    lines = statistics.statistical_report(data[1]).collect()
    p = [r["p_value"] for r in lines]
    assert len(lines) == 5 + 2 + 1 and p == sorted(p)
