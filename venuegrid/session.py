"""Session set-up and the shared work folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from venuegrid.sources import folders

WORK_KEY, CHECKPOINT_KEY = "spark.venuegrid.work.dir", "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 4, app: str = "venuegrid") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")  # plans name whole paths
        .config("spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version", "2")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.venuegrid.work.dir``, else ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, which is then kept
    under the first key: on a cluster an executor's private disk is lost with it.
    """
    for key in (WORK_KEY, CHECKPOINT_KEY):
        root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
        if root:
            return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {WORK_KEY} or {CHECKPOINT_KEY} to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="venuegrid-")
    spark.conf.set(WORK_KEY, root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the work folder."""
    return f"{work_root(spark)}/venuegrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Delete what ``settle`` writes inside the block at its end, also when it fails.

    For jobs that write their results elsewhere. A frame that an operator returns
    may still read settled tables, so it has to be used up inside the block.
    """
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in written:
            folders.delete(spark, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives lost executors, fixes values that two
    consumers must agree on, and gives the optimizer the true size: a join with
    the result is broadcast only when the written files are below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.parquet(path, compression=folders.COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``settle``, with the number of rows, taken while they are written.

    A stage that is done again may be counted again, so the number may choose
    between two ways to the same result but not be part of one.
    """
    seen = Observation()
    settled = settle(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return settled, seen.get["n"]


def discard(df: DataFrame) -> None:
    """Delete the folders in the work folder that ``df`` reads, once nothing needs them."""
    root = f"{work_root(df.sparkSession)}/venuegrid/"
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    folders.delete(spark, path)


def clear_work(spark: SparkSession) -> None:
    """Delete what this application wrote to the work folder; results read from it end too."""
    _delete(spark, f"{work_root(spark)}/venuegrid/{spark.sparkContext.applicationId}")
