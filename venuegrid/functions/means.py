"""Means of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: Column, where: Column | None = None) -> Column:
    """Mean of the values as they are; null when nothing counts.

    A sum of doubles may change in its last digits with the order of the tasks;
    comparisons of means have to allow for that.
    """
    return F.avg(value if where is None else F.when(where, value))
