"""Rows dealt out over as many tasks as they need."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASK_ROWS = 500_000  # rows that one task sorts or counts


def tasks_for(rows: int, least: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks for ``rows`` rows, ``least`` or more, none with more than ``task_rows`` rows on average."""
    return max(least, -(-rows // task_rows))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, hash-partitioned by ``keys`` so that a task's share does not grow with the table.

    Groupings by these and further columns, and joins of two frames spread alike, need no other shuffle.
    """
    return df.repartition(tasks_for(rows, df.sparkSession.sparkContext.defaultParallelism), *keys)
