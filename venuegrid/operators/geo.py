"""Dense location groups (DBSCAN with great-circle distance) inside each (country, city).

No step compares all rows of a city, or all pairs of a dense spot:

* Equal coordinates are one location with a weight.
* Locations fall into cubes whose diagonal is at most the radius. A cube with
  ``min_pts`` rows is *dense*: all its rows are core and connected, so it is one
  node. Any other cube holds fewer than ``min_pts`` rows.
* Two cubes are compared through their bounding boxes. When a pair is neither
  surely within nor surely beyond the radius, small ones are compared point by
  point, large ones are halved along each axis and compared again.
* Nodes are joined by connected components.

Listings need unique ids. Clusters are numbered by their smallest core id, and a
border listing goes to the lowest-numbered cluster it touches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.components import connected_components
from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.ranks import LEAF_ROWS, numbered, value_ranks
from venuegrid.functions.sphere import AXES, box_gap2, box_span2, haversine, unit_vector
from venuegrid.schema import EARTH_RADIUS_M
from venuegrid.session import settle

PAIR_LIMIT = 256   # point pairs compared directly for one pair of boxes

_GROUP = ["g_country", "g_city"]
_CUBE = ["cx", "cy", "cz"]
_BOX = [f"{end}_{k}" for k in AXES for end in ("lo", "hi")]


@dataclass(frozen=True)
class _Reach:
    """The radius as an angle, and as a chord with room for rounding."""

    radius_m: float

    @property
    def angle(self) -> float:
        return self.radius_m / EARTH_RADIUS_M

    @property
    def chord(self) -> float:
        return 2.0 * math.sin(min(self.angle, math.pi) / 2.0)

    @property
    def slack(self) -> float:
        return 1e-9 * self.chord + 4e-15

    @property
    def side(self) -> float:
        side = (self.chord - self.slack) / math.sqrt(3.0)
        if side <= 0:
            raise ValueError("radius is below coordinate precision")
        return side

    @property
    def levels(self) -> int:
        """Halvings after which a box is smaller than coordinate rounding."""
        return max(0, 52 - math.ceil(math.log2(1.0 / min(self.side, 1.0))))

    def surely_within(self, a: str, b: str) -> Column:
        return box_span2(a, b) <= (self.chord - self.slack) ** 2

    def surely_beyond(self, a: str, b: str) -> Column:
        return box_gap2(a, b) > (self.chord + self.slack) ** 2

    def near(self, a: str, b: str) -> Column:
        angle = haversine(*[F.col(f"{p}_{c}") for p in (a, b) for c in ("lat", "lon")])
        return angle <= self.angle


def valid_points(df: DataFrame) -> DataFrame:
    """Rows that have both coordinates."""
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def map_points(df: DataFrame) -> DataFrame:
    return valid_points(df).select(
        "restaurant_id", "restaurant_name", "city", "locality", "currency",
        "longitude", "latitude", "aggregate_rating",
    )


def _prefixed(df: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keep})


def _cube_keys(side: float, level: Column | int = 0) -> dict[str, Column]:
    scale = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return {c: F.floor(F.col(k) / F.lit(side) * scale).cast("bigint") for c, k in zip(_CUBE, AXES)}


def _box_of() -> list[Column]:
    return [f(k).alias(f"{end}_{k}") for k in AXES for end, f in (("lo", F.min), ("hi", F.max))]


def _locations(points: DataFrame, reach: _Reach) -> DataFrame:
    """Distinct coordinates per group with row weight, number and cube.

    Listing ids may repeat or be missing, so a location has a number of its own;
    numbers follow the smallest listing id, missing ones last.
    """
    # Keys without nulls, still one-to-one, keep the many joins below plain equi-joins.
    group = {
        "g_country": F.coalesce(F.col("country_code").cast("bigint"), F.lit(-(2**40))),
        "g_city": F.coalesce(F.concat(F.lit("="), F.col("city")), F.lit("")),
    }
    spots = points.withColumns(group).groupBy(*_GROUP, "latitude", "longitude").agg(
        F.count("*").alias("w"), F.min("restaurant_id").alias("_first")
    )
    order = [F.col("_first").asc_nulls_last(), *[F.col(c) for c in (*_GROUP, "latitude", "longitude")]]
    spots = numbered(spots, order, "id").drop("_first")
    x, y, z = unit_vector(F.col("latitude"), F.col("longitude"))
    spots = spots.withColumns({"x": x, "y": y, "z": z}).withColumns(_cube_keys(reach.side))
    return spots.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})


def _cubes(spots: DataFrame, min_pts: int) -> DataFrame:
    cubes = spots.groupBy(*_GROUP, *_CUBE).agg(
        F.sum("w").alias("w"), F.count("*").alias("n"), F.min("id").alias("node"), *_box_of()
    )
    return cubes.withColumn("dense", F.col("w") >= min_pts)


def _neighbour_cubes(cubes: DataFrame, reach: _Reach) -> DataFrame:
    """Unordered pairs of cubes of one group whose boxes may be within reach.

    A cube lies at most two steps away along each axis. Half of the steps are
    enough for unordered pairs, and steps that leave the sphere's surface meet
    no cube, so they are dropped before the shuffle.
    """
    ahead = [s for s in product((-2, -1, 0, 1, 2), repeat=3) if s > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(_CUBE, s)]) for s in ahead])
    left = _prefixed(cubes, "a", _GROUP).withColumn("_step", F.explode(steps))
    left = left.withColumns({c: F.col(f"a_{c}") + F.col(f"_step.{c}") for c in _CUBE}).drop("_step")
    middle = [(F.col(c) + 0.5) * reach.side for c in _CUBE]
    height = F.sqrt(sum((m * m for m in middle[1:]), middle[0] * middle[0]))
    left = left.where(F.abs(height - 1.0) <= reach.side * math.sqrt(3.0) / 2 * 1.000001 + 1e-12)
    right = _prefixed(cubes, "b", _GROUP).withColumnsRenamed({f"b_{c}": c for c in _CUBE})
    pairs = left.join(right, [*_GROUP, *_CUBE]).where(~reach.surely_beyond("a", "b"))
    return pairs.withColumnsRenamed({c: f"b_{c}" for c in _CUBE})


def _sparse_neighbours(spots: DataFrame, cubes: DataFrame, pairs: DataFrame, reach: _Reach) -> DataFrame:
    """(a, b, w): sparse location ``a`` and sparse location ``b`` of weight ``w`` within reach.

    A sparse cube holds fewer than ``min_pts`` locations, which limits the pairs.
    """
    loose = spots.join(cubes.where("not dense").select(*_GROUP, *_CUBE, "node"), [*_GROUP, *_CUBE])
    loose = loose.select("node", "id", "w", "lat", "lon")
    a, b = _prefixed(loose, "a"), _prefixed(loose, "b")
    both = pairs.where("not a_dense and not b_dense").select("a_node", "b_node")
    across = both.join(a, "a_node").join(b, "b_node").where(reach.near("a", "b"))
    across = across.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_w", "b_w")
    back = across.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_w").alias("w"))
    within = a.join(b, F.col("a_node") == F.col("b_node")).where("a_id <> b_id")
    within = within.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("b_w").alias("w"))
    return across.select("a", "b", F.col("b_w").alias("w")).unionByName(back).unionByName(within)


def _compare_boxes(items: DataFrame, dense: DataFrame, reach: _Reach, pair_limit: int) -> DataFrame:
    """(a, b, w): rows of ``b`` known to be within reach of ``a``, at least ``need`` of them if so many exist.

    ``a`` is a sparse location or, for two dense cubes, a dense cube. Pairs not
    listed have none. ``items`` are box pairs of level 0; ``dense`` are the
    locations of dense cubes with their ``node``.
    """
    hits = []
    for level in range(reach.levels + 1):
        items = settle(items.where(~reach.surely_beyond("a", "b")), "boxes")
        if not items.head(1):
            break
        sure = reach.surely_within("a", "b")
        small = (F.col("a_n") * F.col("b_n") <= pair_limit) if level < reach.levels else F.lit(True)
        keyed = dense.withColumns(_cube_keys(reach.side, level)).select("node", *_CUBE, "w", "lat", "lon")
        a, b = _prefixed(keyed, "a"), _prefixed(keyed, "b")

        hits.append(items.where(sure).select("a", "b", "need", F.col("b_w").alias("w")))
        direct = items.where(~sure & small)
        wanted = ["a", "b", "need", "a_lat", "a_lon"]
        points = direct.where("a_node is null").select(*wanted, "b_node", *[f"b_{c}" for c in _CUBE])
        both = direct.where("a_node is not null").drop("a_lat", "a_lon", "a_w", "b_w")
        both = both.join(a, ["a_node", *[f"a_{c}" for c in _CUBE]])
        points = points.unionByName(both.select(*points.columns))
        met = points.join(b, ["b_node", *[f"b_{c}" for c in _CUBE]]).where(reach.near("a", "b"))
        hits.append(met.groupBy("a", "b", "need").agg(F.sum("b_w").alias("w")))

        unclear = items.where(~sure & ~small)
        if not unclear.head(1):
            break
        found = reduce(DataFrame.unionByName, hits).groupBy("a", "b", "need").agg(F.sum("w").alias("w"))
        found = settle(found, "found")
        hits = [found]
        done = found.where("w >= need").select("a", "b")
        items = _halved(unclear.join(done, ["a", "b"], "left_anti"), dense, reach, level)
    if not hits:
        return None
    return reduce(DataFrame.unionByName, hits).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _halved(items: DataFrame, dense: DataFrame, reach: _Reach, level: int) -> DataFrame:
    """The open items one level finer, on both sides; a single location stays as it is."""
    finer = dense.withColumns(_cube_keys(reach.side, level + 1))
    nodes = items.select(F.col("b_node").alias("node")).unionByName(
        items.where("a_node is not null").select(F.col("a_node").alias("node"))
    ).distinct()
    parts = finer.join(nodes, "node", "left_semi").groupBy("node", *_CUBE).agg(
        F.sum("w").alias("w"), F.count("*").alias("n"), *_box_of()
    )
    parts = settle(parts.withColumns({f"up_{c}": F.shiftright(c, 1) for c in _CUBE}), "parts")

    def replaced(df: DataFrame, side: str) -> DataFrame:
        stale = [f"{side}_{c}" for c in ("w", "n", *_BOX)]
        fresh = _prefixed(parts, side).withColumnsRenamed({f"{side}_{c}": f"_{c}" for c in _CUBE})
        fresh = fresh.withColumnsRenamed({f"{side}_up_{c}": f"{side}_{c}" for c in _CUBE})
        finer_keys = {f"{side}_{c}": F.col(f"_{c}") for c in _CUBE}
        joined = df.drop(*stale).join(fresh, [f"{side}_node", *[f"{side}_{c}" for c in _CUBE]])
        return joined.withColumns(finer_keys).drop(*[f"_{c}" for c in _CUBE])

    single, cubes = items.where("a_node is null"), items.where("a_node is not null")
    halves = replaced(cubes, "a").unionByName(single)
    return replaced(halves, "b").select(*items.columns)


def _box_items(spots: DataFrame, cubes: DataFrame, pairs: DataFrame, min_pts: int) -> DataFrame:
    """Level-0 items: dense cube with dense cube, and sparse location with dense cube."""
    shape = ["w", "n", *_CUBE, *_BOX]
    two = pairs.where("a_dense and b_dense").select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.lit(1).alias("need"), "a_node", "b_node",
        F.lit(None).cast("double").alias("a_lat"), F.lit(None).cast("double").alias("a_lon"),
        *[f"{s}_{c}" for s in ("a", "b") for c in shape],
    )
    # Turn mixed pairs round so that the sparse cube is on the left.
    mixed = pairs.where("a_dense <> b_dense")
    right = mixed.where("b_dense").select("a_node", "b_node", *[f"b_{c}" for c in shape])
    left = mixed.where("a_dense").select(
        F.col("b_node").alias("a_node"), F.col("a_node").alias("b_node"), *[F.col(f"a_{c}").alias(f"b_{c}") for c in shape]
    )
    mixed = right.unionByName(left)
    loose = spots.join(cubes.where("not dense").select(*_GROUP, *_CUBE, F.col("node").alias("a_node")), [*_GROUP, *_CUBE])
    one = mixed.join(loose, "a_node").select(
        F.col("id").alias("a"), F.col("b_node").alias("b"), F.lit(min_pts).alias("need"),
        F.lit(None).cast("bigint").alias("a_node"), "b_node",
        F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
        F.col("w").alias("a_w"), F.lit(1).cast("bigint").alias("a_n"), *[F.col(c).alias(f"a_{c}") for c in _CUBE],
        *[F.col(k).alias(f"a_{end}_{k}") for k in AXES for end in ("lo", "hi")],
        *[f"b_{c}" for c in shape],
    )
    return two.unionByName(one)


@dataclass(frozen=True)
class _Density:
    spots: DataFrame   # locations with node (dense cube or null), core flag
    touches: DataFrame  # (a, b): location or cube a within reach of location or cube b


def _density(points: DataFrame, radius_m: float, min_pts: int, pair_limit: int) -> _Density:
    reach = _Reach(radius_m)
    spots = settle(_locations(points, reach), "spots")
    cubes = settle(_cubes(spots, min_pts), "cubes")
    pairs = settle(_neighbour_cubes(cubes, reach), "cube-pairs")

    nodes = cubes.select(*_GROUP, *_CUBE, F.col("w").alias("cube_w"), F.when(F.col("dense"), F.col("node")).alias("node"))
    spots = settle(spots.join(nodes, [*_GROUP, *_CUBE]), "placed")
    dense = spots.where("node is not null")
    loose = spots.where("node is null")

    sparse = _sparse_neighbours(spots.drop("node", "cube_w"), cubes, pairs, reach)
    boxed = _compare_boxes(
        _box_items(loose.drop("node", "cube_w"), cubes, pairs, min_pts), dense, reach, pair_limit
    )
    touches = sparse if boxed is None else sparse.unionByName(boxed)
    touches = settle(touches, "touches")

    # Same-cube weight is in cube_w already; add what other cubes contribute.
    home = loose.select(F.col("id").alias("a"), *_GROUP, *_CUBE)
    away = touches.join(home, "a").join(
        loose.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in _CUBE]), "b", "left"
    )
    other = ~reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in _CUBE])
    extra = away.where(other).groupBy("a").agg(F.sum("w").alias("away_w"))
    spots = spots.join(extra.withColumnRenamed("a", "id"), "id", "left")
    weight = F.col("cube_w") + F.coalesce("away_w", F.lit(0))
    spots = settle(spots.withColumn("core", F.col("node").isNotNull() | (weight >= min_pts)), "cores")
    return _Density(spots, touches.select("a", "b"))


def _back_to_rows(points: DataFrame, spots: DataFrame) -> DataFrame:
    """Location results on every listing; copies of a location are joined, never paired."""
    keys = points.select("country_code", "city", "latitude", "longitude")
    group = {
        "country_code": F.when(F.col("g_country") != -(2**40), F.col("g_country")).cast(keys.schema["country_code"].dataType),
        "city": F.when(F.col("g_city") != "", F.substring("g_city", 2, 2**31 - 1)),
    }
    spots = spots.withColumns(group).drop(*_GROUP).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return null_safe_join(points, spots, keys.columns)


def neighbours_within(
    points: DataFrame, radius_m: float = 500, min_pts: int = 5, pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """Located listings with ``is_core``: at least ``min_pts`` listings within reach, itself included."""
    located = valid_points(points).select("restaurant_id", "country_code", "city", "latitude", "longitude")
    spots = _density(located, radius_m, min_pts, pair_limit).spots
    cores = spots.select(*_GROUP, "lat", "lon", F.col("core").alias("is_core"))
    return _back_to_rows(located, cores).select("restaurant_id", "country_code", "city", "is_core")


def spatial_clusters(
    points: DataFrame,
    radius_m: float = 500,
    min_pts: int = 5,
    pair_limit: int = PAIR_LIMIT,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Located listings with ``cluster_label`` (-1 for noise) and ``cluster_size`` (0 for noise)."""
    located = valid_points(points)
    found = _density(located, radius_m, min_pts, pair_limit)
    spots, touches = found.spots, found.touches

    # A node is a dense cube or one core location, named by its smallest id.
    named = spots.withColumn("node", F.when(F.col("core"), F.coalesce("node", "id")))
    cores = named.where("core").select("node").distinct()
    linked = touches.join(cores.withColumnRenamed("node", "a"), "a", "left_semi")
    linked = linked.join(cores.withColumnRenamed("node", "b"), "b", "left_semi")
    components = connected_components(linked)
    component = settle(
        cores.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component")),
        "components",
    )

    # Border locations take the component with the smallest core id.
    border = touches.join(component.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
        F.min("component").alias("border")
    )
    labelled = named.join(component, "node", "left").join(border.withColumnRenamed("a", "id"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "border"))
    labelled = settle(labelled.select(*_GROUP, "lat", "lon", "w", "component"), "labelled")

    # One line per cluster; numbers are ranks of the smallest core id in the group.
    clusters = labelled.where("component is not null").groupBy(*_GROUP, "component").agg(F.sum("w").alias("cluster_size"))
    numbers = value_ranks(clusters, _GROUP, "component", leaf_rows=leaf_rows)
    clusters = clusters.join(numbers, [*_GROUP, "component"]).select(
        *_GROUP, "component", "cluster_size", F.col("below").alias("cluster_label")
    )
    spots = labelled.join(clusters, [*_GROUP, "component"], "left").select(
        *_GROUP, "lat", "lon",
        F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"),
        F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"),
    )
    return _back_to_rows(located, spots).select(*located.columns, "cluster_label", "cluster_size")


def cluster_summary(clustered: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` largest clusters with their mean position."""
    kept = clustered.where(
        (F.col("cluster_label") >= 0) & F.col("country_code").isNotNull() & F.col("city").isNotNull()
    )
    groups = kept.groupBy("country_code", "city", "cluster_label").agg(
        F.count_distinct("restaurant_id").alias("restaurants"),
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
    )
    return groups.orderBy(F.desc("restaurants"), "country_code", "city", "cluster_label").limit(k)
