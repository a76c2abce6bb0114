"""Intermediate tables of one operator call, deleted once they are not needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from venuegrid.session import work_path
from venuegrid.sources.folders import COMPRESSION


class Scratch:
    """Writes tables to the shared work folder and deletes them, but for the one that a result reads.

    ::

        with Scratch(spark) as scratch:
            lines = scratch.settle(lines, "lines")
            return scratch.keep(result, "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self._paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self._paths = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` for good and read it back; this cuts the lineage and survives lost executors."""
        path = work_path(self.spark, name)
        df.write.parquet(path, compression=COMPRESSION)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """As ``keep``, until the end of the block."""
        path = work_path(self.spark, name)
        self._paths.append(path)
        df.write.parquet(path, compression=COMPRESSION)
        return self.spark.read.schema(df.schema).parquet(path)
