"""Pass rows through Python in Arrow blocks and add one result column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from venuegrid.llm import words
from venuegrid.llm.ship import ship

#: (offsets, bytes) of the texts of a block -> one plain Arrow struct for each text
Annotate = Callable[[np.ndarray, np.ndarray], pa.StructArray]


def annotated(df: DataFrame, text: str, into: str, kind: T.StructType, start: Callable[[], Annotate], block_bytes: int = words.BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``df`` with the struct column ``into``; a column of that name is replaced.

    ``start`` runs once in each task and returns the function for its blocks; what
    that function keeps for later blocks, its ``close`` empties when the task ends.
    Rows stay where they are, so equal rows, missing ids and extra columns need
    no treatment, and a lost task is simply done again.
    """
    ship(df.sparkSession)
    plain = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != into.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annotate = start()
        try:
            for rows, offsets, data in words.blocks(batches, text, block_bytes):
                found = annotate(offsets, data)
                yield pa.RecordBatch.from_arrays([*rows.columns, found], names=[*rows.schema.names, into])
        finally:
            getattr(annotate, "close", words.let_go)()
            words.let_go()

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(into, kind)]))


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] values, then those of first[1], and so on."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - first, count)
