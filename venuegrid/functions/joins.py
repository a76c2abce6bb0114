"""Equi-joins in which a missing key equals a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", where: Column | None = None
) -> DataFrame:
    """Join on ``keys`` with ``<=>``, which Spark still plans as an equi-join.

    The keys of ``left`` are kept. Other columns must have different names on
    the two sides; ``where`` may use them.
    """
    hidden = {k: f"_right_{k}" for k in keys}
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in hidden.items()])
    if where is not None:
        match = match & where
    return left.join(right.withColumnsRenamed(hidden), match, how).drop(*hidden.values())
