"""Clusters against an all-pairs reference on small point sets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from venuegrid.functions.components import connected_components
from venuegrid.operators import geo
from venuegrid.schema import EARTH_RADIUS_M


def all_pairs(points, radius, min_pts):
    """Clusters by comparing every pair of every group."""
    done = []
    for _, g in points.groupby(["country_code", "city"], dropna=False):
        g = g.sort_values("restaurant_id").reset_index(drop=True)
        lat, lon = np.radians(g.latitude.to_numpy()), np.radians(g.longitude.to_numpy())
        h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        near = 2 * np.arcsin(np.sqrt(np.minimum(h, 1))) <= radius / EARTH_RADIUS_M
        core = near.sum(axis=1) >= min_pts
        reach = near & core[:, None] & core[None, :]
        root = np.where(core, np.arange(len(g)), len(g))
        while True:
            lower = np.minimum(root, np.where(reach, root[None, :], len(g)).min(axis=1))
            if (lower == root).all():
                break
            root = lower
        border = np.where(near & core[None, :], root[None, :], len(g)).min(axis=1)
        root = np.where(core, root, border)
        numbers = {r: i for i, r in enumerate(sorted(set(root) - {len(g)}))}
        label = np.array([numbers.get(r, -1) for r in root])
        size = np.array([0 if x < 0 else (label == x).sum() for x in label])
        done.append(g.assign(want_label=label, want_size=size, want_core=core))
    return pd.concat(done)


def scattered(seed, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-0.04, 0.04, (8, 2))
    offset = centres[rng.integers(0, 8, n)] + rng.normal(0, 0.004, (n, 2))
    offset[:n // 3] = offset[0]                                          # a third at one place
    offset[n // 3:n // 2] = offset[-1] + rng.normal(0, 0.0003, (n // 2 - n // 3, 2))  # a dense spot
    points = pd.DataFrame({
        "restaurant_id": rng.permutation(n) + 1,
        "country_code": rng.choice([1, 2], n).astype("int64"),
        "city": rng.choice(["A", None], n, p=[0.8, 0.2]),
        "latitude": offset[:, 0] + 10,
        "longitude": (offset[:, 1] + 360) % 360 - 180,                   # across the antimeridian
    })
    pole = rng.random(n) < 0.2
    points.loc[pole, "latitude"] = np.minimum(89.96 + offset[pole, 0], 90.0)
    points.loc[pole, "longitude"] = rng.uniform(-180, 180, pole.sum())
    return points


def check(frame, want):
    got = frame.toPandas().merge(want, on="restaurant_id")
    assert len(got) == len(want)
    assert (got["cluster_label"] == got["want_label"]).all()
    assert (got["cluster_size"] == got["want_size"]).all()


@pytest.mark.parametrize("seed, pair_limit", [(1, 256), (2, 1)])
def test_clusters_equal_all_pairs(spark, seed, pair_limit):
    points = scattered(seed)
    want = all_pairs(points, 500, 5)
    assert want.want_label.max() > 2 and (want.want_label == -1).sum() > 10
    check(geo.spatial_clusters(spark.createDataFrame(points), 500, 5, pair_limit), want)


def test_clusters_do_not_depend_on_row_order(spark):
    points = scattered(3, 300)
    frame = spark.createDataFrame(points).orderBy(F.rand(5)).repartition(7)
    check(geo.spatial_clusters(frame, 700, 4), all_pairs(points, 700, 4))


def test_core_flags(spark):
    points = scattered(4, 300)
    got = geo.neighbours_within(spark.createDataFrame(points), 500, 5, pair_limit=4).toPandas()
    both = got.merge(all_pairs(points, 500, 5), on="restaurant_id")
    assert len(both) == 300 and (both["is_core"] == both["want_core"]).all()


def test_five_close_points_and_one_far_away(spark):
    near = [(0, 0), (0.0001, 0.0001), (-0.0001, -0.0001), (0.0002, -0.0002), (-0.0002, 0.0002), (0.1, 0.1)]
    rows = [(i, 1, "A", float(a), float(o)) for i, (a, o) in enumerate(near, 1)]
    frame = spark.createDataFrame(rows, "restaurant_id long, country_code int, city string, latitude double, longitude double")
    got = geo.spatial_clusters(frame).orderBy("restaurant_id").collect()
    assert [r["cluster_label"] for r in got] == [0] * 5 + [-1]
    assert [r["cluster_size"] for r in got] == [5] * 5 + [0]
    assert geo.cluster_summary(geo.spatial_clusters(frame)).collect()[0]["restaurants"] == 5


def test_unlocated_rows_leave_and_empty_input_keeps_the_columns(spark):
    rows = [(1, 1, "A", None, 2.0), (2, 1, "A", 1.0, None)]
    frame = spark.createDataFrame(rows, "restaurant_id long, country_code int, city string, latitude double, longitude double")
    got = geo.spatial_clusters(frame)
    assert got.columns == [*frame.columns, "cluster_label", "cluster_size"] and got.count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    loose = [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    edges = path + star + loose
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {v: find(v) for v in parent}


def test_clusters_do_not_need_unique_ids(spark):
    chain = [(k, 1, "A", 10.0 + k * 0.001, 10.0) for k in range(7)]  # ids shared with scattered points of another city
    scattered = [(k, 1, "B", 40.0 + k, 20.0) for k in range(7)]
    missing = [(None, 1, "C", 50.0 + k * 0.0001, 5.0) for k in range(5)]
    frame = spark.createDataFrame(chain + scattered + missing, "restaurant_id long, country_code int, city string, latitude double, longitude double")
    rows = geo.spatial_clusters(frame, radius_m=500, min_pts=3).collect()
    found = {}
    for r in rows:
        found.setdefault(r.city, []).append((r.cluster_label, r.cluster_size))
    assert found == {"A": [(0, 7)] * 7, "B": [(-1, 0)] * 7, "C": [(0, 5)] * 5}
