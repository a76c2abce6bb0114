"""Tails for very many degrees of freedom, against sums and integrals."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest

from venuegrid.functions import distributions
from venuegrid.functions.distributions import beta_share, chi2_tail, gamma_tail, t_two_sided


def _chi2_by_poisson(x, half):
    """Upper tail for 2 * half degrees of freedom: a Poisson sum with 50 digits."""
    getcontext().prec = 50
    mean = Decimal(x) / 2
    term = total = Decimal(1)
    for k in range(1, half):
        term = term * mean / k
        total += term
    return float(total * (-mean).exp())


def _t_by_integral(t, df):
    """Simpson's rule over the density, scaled by its own integral."""
    def area(low, high, steps):
        x = np.linspace(low, high, 2 * steps + 1, dtype=np.longdouble)
        y = np.exp(-(np.longdouble(df) + 1) / 2 * np.log1p(x * x / np.longdouble(df)))
        weight = np.ones(len(x), np.longdouble)
        weight[1:-1:2], weight[2:-1:2] = 4, 2
        return (y * weight).sum() * (x[1] - x[0]) / 3

    return float(area(t, 45, 200_000) / area(0, 45, 200_000))


@pytest.mark.parametrize("half, deviation", [(5_000, -3), (10_001, 0), (10_001, 0.001), (10_001, 4), (20_000, 12), (50_000, -1), (50_000, 6)])
def test_chi2_tail_is_the_poisson_sum(half, deviation):
    x = 2 * half + deviation * math.sqrt(4 * half)
    assert chi2_tail(x, 2 * half) == pytest.approx(_chi2_by_poisson(x, half), rel=1e-10)


@pytest.mark.parametrize("df", [10_001, 123_456.7, 1e9])
@pytest.mark.parametrize("t", [0.01, 0.7, 2.5, 8.0, 20.0])
def test_t_tail_is_the_integral(df, t):
    assert t_two_sided(t, df) == pytest.approx(_t_by_integral(t, df), rel=1e-9)
    assert t_two_sided(-t, df) == t_two_sided(t, df)


@pytest.mark.parametrize("t", [0.0, 1e-6, 1.0, 5.0, 30.0])
def test_t_tail_ends_in_the_normal_tail(t):
    assert t_two_sided(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)
    first_order = math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t ** 3 + t) / 2e12
    assert t_two_sided(t, 1e12) == pytest.approx(first_order, rel=1e-9)


@pytest.mark.parametrize("z", [-5, -0.1, 0, 0.1, 2, 5])
def test_chi2_tail_ends_in_the_normal_tail(z):
    df = 1e12
    skew = math.sqrt(8 / df)
    first_order = math.erfc(z / math.sqrt(2)) / 2 + skew / 6 * (z * z - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert chi2_tail(df + z * math.sqrt(2 * df), df) == pytest.approx(first_order, rel=1e-8)


def test_both_ways_meet_at_the_limit():
    below, above = 10_000.0, 10_000.0 * (1 + 1e-12)
    for t in (0.5, 2.0, 9.0):
        assert t_two_sided(t, above) == pytest.approx(t_two_sided(t, below), rel=1e-10)
    for x in (9_700.0, 20_000.0, 20_900.0):
        assert gamma_tail(above, x / 2) == pytest.approx(gamma_tail(below, x / 2), rel=1e-9, abs=1e-300)


def test_far_tails():
    assert chi2_tail(1e9, 1e6) == 0.0 and chi2_tail(1.0, 1e6) == 1.0
    assert t_two_sided(1e6, 1e6) == 0.0
    assert math.isnan(t_two_sided(math.nan, 1e6)) and math.isnan(chi2_tail(1.0, 0))


def test_a_series_that_does_not_settle_raises(monkeypatch):
    monkeypatch.setattr(distributions, "_MAX_TERMS", 4)
    with pytest.raises(ArithmeticError):
        beta_share(0.3, 40.0, 60.0)
    with pytest.raises(ArithmeticError):
        gamma_tail(50.0, 45.0)
    with pytest.raises(ArithmeticError):
        gamma_tail(50.0, 60.0)
