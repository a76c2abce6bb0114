"""Exact ranks and quantiles of groups that may be too large for one task.

A window over the rows of a group, or the built-in exact ``percentile``, gathers a
group in one task. Here equal values are counted first, with partial sums before the
shuffle, so a value that very many rows share is one line. The lines are written once. If they
are few, one window adds up each group. Otherwise they are sorted by range over
all tasks, and each range counts on from the totals of the ranges before it, so
a task never holds more than its range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.functions.joins import null_safe_join
from venuegrid.session import settle, settle_counted

LEAF_ROWS = 2_000_000    # distinct values of all groups up to which a window over a whole group is used


def _counted(df: DataFrame, by: Sequence[str], value: str, weight: str | None) -> tuple[DataFrame, list[str]]:
    """Keys, ``_v`` and ``equal``, a line for each distinct value; a constant key stands in for an empty ``by``."""
    keep = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        keep = keep & ~F.isnan(value)
    keys = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    counted = [F.col(weight).cast("bigint").alias("_w")] if weight else []
    rows = df.where(keep).select(*keys, F.col(value).alias("_v"), *counted)
    names = list(by) or ["_all"]
    return rows.groupBy(*names, "_v").agg((F.sum("_w") if weight else F.count("*")).alias("equal")), names


def _placed(df: DataFrame, by: Sequence[str], value: str, weight: str | None, leaf_rows: int) -> tuple[DataFrame, list[str]]:
    """Each distinct value of each group with ``equal``, ``below`` and ``total``."""
    lines, keys = _counted(df, by, value, weight)
    lines, n = settle_counted(lines, "values")
    if n <= leaf_rows:
        group = Window.partitionBy(*keys)
        below = F.sum("equal").over(group.orderBy("_v")) - F.col("equal")
        return lines.withColumns({"below": below, "total": F.sum("equal").over(group)}), keys
    dealt = settle(lines.repartitionByRange(2 * -(-n // leaf_rows), *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "_part").agg(F.sum("equal").alias("_n"))  # a line for each range, and for each group in it
    group = Window.partitionBy(*keys)
    before = F.sum("_n").over(group.orderBy("_part")) - F.col("_n")
    starts = totals.select(*keys, "_part", before.alias("_start"), F.sum("_n").over(group).alias("total"))
    inside = F.sum("equal").over(Window.partitionBy(*keys, "_part").orderBy("_v")) - F.col("equal")
    placed = null_safe_join(dealt.withColumn("_inside", inside), starts, [*keys, "_part"])
    return placed.select(*keys, "_v", "equal", (F.col("_start") + F.col("_inside")).alias("below"), "total"), keys


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    leaf_rows: int = LEAF_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Values at given 0-based ranks of each group, exact.

    ``ranks`` maps the group size to an array of ranks. The result has the keys
    plus ``total``, ``rank``, ``value``, ``below`` (rows strictly smaller than the
    value) and ``equal`` (rows equal to it). Null keys form a group. With
    ``weight``, every row stands for that many rows.
    """
    placed, _ = _placed(df, by, value, weight, leaf_rows)
    here = F.filter(F.array_distinct(ranks(F.col("total"))), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("equal")))
    found = placed.withColumn("rank", F.explode(here))
    return found.select(*by, "total", "rank", F.col("_v").alias("value"), "below", "equal")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], leaf_rows: int = LEAF_ROWS, weight: str | None = None,
) -> DataFrame:
    """One row per group with ``n`` and one linearly interpolated quantile per name."""

    def position(total: Column, p: float) -> Column:
        return (total - 1).cast("double") * F.lit(float(p))

    def wanted(total: Column) -> Column:
        ends = [f(position(total, p)).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)]
        return F.array(*ends)

    stats = order_statistics(df, by, value, wanted, leaf_rows, weight)
    picked = [F.max("total").alias("n")]
    for name, p in probs.items():
        at = position(F.col("total"), p)
        low = F.max(F.when(F.col("rank") == F.floor(at), F.col("value").cast("double")))
        high = F.max(F.when(F.col("rank") == F.ceil(at), F.col("value").cast("double")))
        share, gap = F.max(at - F.floor(at)), high - low
        # From the nearer end, so that the result never leaves [low, high].
        value = F.when(share < 0.5, low + gap * share).otherwise(high - gap * (1 - share))
        picked.append(value.alias(name))
    return stats.groupBy(*by).agg(*picked)


def value_ranks(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Each distinct value of each group with ``equal``, ``below`` and ``total`` row counts.

    The average rank of a value is ``below + (equal + 1) / 2``. With ``weight``,
    every row stands for that many rows.
    """
    placed, _ = _placed(df, by, value, weight, leaf_rows)
    return placed.select(*by, F.col("_v").alias(value), "equal", "below", "total")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the column ``name``: 0, 1, 2, ... in the given order, which must tell all rows apart.

    Rows are range-sorted over the tasks; each task counts on from the totals of those before it.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn(name, inside).join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
