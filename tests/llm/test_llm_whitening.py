import math
import random
from fractions import Fraction

import numpy as np
import pytest

from venuegrid.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"


def check(vectors, rows, most=8):
    """All figures against the eigenvectors of the whole covariance matrix and exact whole numbers."""
    x = {i: [math.floor(1024 * float(c)) + 100_000 for c in v] for i, v in vectors}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[k] for v in x.values()) for k in range(d)]
    centred = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) for i, v in x.items()}
    every = np.array(list(centred.values()))
    covariance = every.T @ every / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    count = min(most, int((values > 1e-12 * values[0]).sum()))
    assert len(rows) == n * count
    found = {}
    for r in rows:
        found.setdefault(r.component, {})[r.vec_id] = r.whitened
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        assert r.identity_error < 1e-9
    assert sorted(found) == list(range(1, count + 1))
    for k, column in found.items():
        own = np.array([column[i] for i in x])
        gap = min([abs(values[k - 1] - values[j]) for j in (k - 2, k) if 0 <= j < d] or [values[0]])
        if gap > 1e-6 * values[0]:
            expected = np.array([centred[i] @ basis[:, k - 1] / math.sqrt(values[k - 1]) for i in x])
            assert min(np.abs(own - expected).max(), np.abs(own + expected).max()) < 1e-7
        assert abs(own.mean()) < 1e-9 and (own**2).mean() == pytest.approx(1)


def test_query_equals_the_eigenvectors(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(vectors, queries.queries()["op11_whitening"](spark, SMALL).collect())


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in vectors], "vec_id long, embedding array<double>, x double, component int").repartition(3)


def test_equal_deviations_are_all_found(spark):
    draw = np.random.default_rng(1)
    vectors = [(2 * k + s, [float(3 * (2 * s - 1)) if j == k else 0.0 for j in range(12)]) for k in range(12) for s in (0, 1)]
    check(vectors, whitening.whitened(frame_of(spark, vectors)).collect())
    # two equal largest ones among many others
    x = draw.normal(size=(400, 30)) @ np.diag(0.97 ** np.arange(30))
    x = np.linalg.qr(x - x.mean(axis=0))[0] * np.concatenate([[9, 9], np.linspace(7, 2, 28)])
    vectors = [(k, row.tolist()) for k, row in enumerate(np.concatenate([x, -x]))]
    check(vectors, whitening.whitened(frame_of(spark, vectors)).collect())


def test_few_rows_and_dimensions(spark):
    draw = random.Random(3)
    for n, d in ((1, 5), (2, 5), (4, 2), (30, 1)):
        vectors = [(k, [draw.random() for _ in range(d)]) for k in range(n)]
        out = whitening.whitened(frame_of(spark, vectors)).collect()
        assert out == [] if n == 1 else check(vectors, out) is None
    assert whitening.whitened(frame_of(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect() == []


def test_odd_rows_and_columns(spark):
    draw = random.Random(5)
    good = [(k, [draw.gauss(0, 1) * (j + 1) for j in range(6)]) for k in range(60)]
    bad = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [1.0] * 5 + [math.inf]), (104, [math.nan] * 6), (105, [1.0] * 5), (106, [1e300] * 6)]
    rows = whitening.whitened(frame_of(spark, good + bad)).collect()
    check(good, rows)
    again = whitening.whitened(frame_of(spark, [(None, v) for _, v in good] + [(7, good[0][1])] * 3)).collect()
    assert len(again) == 63 * 6 and len({r.whitened for r in again if r.vec_id == 7}) == 6
    assert whitening.whitened(frame_of(spark, good).limit(0)).collect() == []
    assert whitening.whitened(frame_of(spark, bad[:5])).collect() == []


def test_numbers_beyond_64_bits(spark):
    vectors = [(k, [float(2**51 - k), -1.0 * k, 2.0]) for k in range(9)]
    rows = whitening.whitened(frame_of(spark, vectors)).collect()
    assert {r.deviation for r in rows} != set() and all(r.n == 9 and abs(r.whitened) < 3 for r in rows)
    x = np.array([[2**62, 5], [-(2**62), 7]])
    assert whitening.times_n_less_sums(x, 3, [2**63, 1]).tolist() == [[3 * 2**62 - 2**63, 14], [-3 * 2**62 - 2**63, 20]]
