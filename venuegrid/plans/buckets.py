"""Listings and labels as tables bucketed by listing, so that joins between them need no shuffle.

Each table is hash-partitioned and sorted by the listing id when it is written, one
file a bucket. Tables with the same number of buckets join bucket by bucket: one
shuffle when they are written replaces one for every later join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from venuegrid.functions.spread import tasks_for
from venuegrid.plans.publish import Tables
from venuegrid.schema import LABEL_SCHEMA, LISTING_SCHEMA
from venuegrid.sources import folders

KEY = "restaurant_id"
SCHEMAS = {"listings": LISTING_SCHEMA, "labels": LABEL_SCHEMA}


def _place(path: str, name: str, buckets: int) -> str:
    """The number of buckets is part of the folder, so tables are never read by a wrong one."""
    return f"{path.rstrip('/')}/{name}-by-{KEY}-{buckets}"


def buckets_for(tables: Tables, least: int) -> int:
    """``least`` buckets, or as many as hold ``TASK_ROWS`` label rows each: one task sorts a whole bucket."""
    return tasks_for(max(tables.listings.count(), tables.labels.count()), least)


def write_bucketed(tables: Tables, path: str, buckets: int) -> Tables:
    """Write both tables below ``path`` in ``buckets`` buckets and open them; a bucket should fit a task's memory."""
    spark = tables.listings.sparkSession
    for name, schema in SCHEMAS.items():
        place = _place(path, name, buckets)
        spark.sql(f"DROP TABLE IF EXISTS {_table(place)}")
        rows = getattr(tables, name).select(*schema.names).repartition(buckets, KEY)
        writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
        writer.options(path=place, compression=folders.COMPRESSION).saveAsTable(_table(place))
    return load_bucketed(spark, path, buckets)


def load_bucketed(spark: SparkSession, path: str, buckets: int) -> Tables:
    """Both tables as bucketed tables, also in a session that did not write them; the catalog entry only points to the files."""
    return Tables(**{name: _opened(spark, _place(path, name, buckets), schema, buckets) for name, schema in SCHEMAS.items()})


def _opened(spark: SparkSession, place: str, schema, buckets: int) -> DataFrame:
    if not folders.exists(spark, f"{place}/_SUCCESS"):
        raise FileNotFoundError(f"No finished table of {buckets} buckets: {place}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table(place)} ({columns}) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(_table(place))


def _table(place: str) -> str:
    return f"venuegrid_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
