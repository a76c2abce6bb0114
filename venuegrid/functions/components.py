"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.session import settle

MAX_ROUNDS = 200
SETTLE_EVERY = 6  # rounds after which the names are written, to keep the plan short


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) edges; a component is named by its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed
    twice, and the edge list is contracted. The edges left shrink by a large
    factor per round, and an edge list without edges ends the loop.
    """
    forward = edges.where("a <> b").select("a", "b")
    links = settle(forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    names = links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for turn in range(1, MAX_ROUNDS + 1):
        if not links.head(1):
            return names
        pointers = links.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        pointers = settle(_follow(_follow(pointers)).where("to < a"), "pointers")
        names = _renamed(names, pointers, "component")
        if turn % SETTLE_EVERY == 0:
            names = settle(names, "names")
        links = _renamed(_renamed(links, pointers, "a"), pointers, "b")
        links = settle(links.where("a <> b").distinct(), "links")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _follow(pointers: DataFrame) -> DataFrame:
    further = pointers.select(F.col("a").alias("_at"), F.col("to").alias("_next"))
    hop = pointers.join(further, F.col("to") == F.col("_at"), "left")
    return hop.select("a", F.coalesce("_next", "to").alias("to"))


def _renamed(df: DataFrame, pointers: DataFrame, column: str) -> DataFrame:
    to = pointers.select(F.col("a").alias("_at"), F.col("to").alias("_next"))
    moved = df.join(to, F.col(column) == F.col("_at"), "left")
    return moved.withColumn(column, F.coalesce("_next", column)).drop("_at", "_next")
