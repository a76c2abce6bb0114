"""Files and folders through the file system that owns their path, so HDFS and object stores work too."""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

COMPRESSION = "zstd"  # of Parquet files: smaller than the default


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _open(spark, path)
    return system.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; none if there is no such folder."""
    system, target = _open(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(target)) if system.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    system, target = _open(spark, path)
    system.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _open(spark, path)
    java = spark._jvm.java
    reader = java.io.BufferedReader(java.io.InputStreamReader(system.open(target), "UTF-8"))
    try:
        return reader.lines().collect(java.util.stream.Collectors.joining("\n"))
    finally:
        reader.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if there is one of that name already."""
    system, target = _open(spark, path)
    try:
        out = system.create(target, False)
    except Py4JJavaError:
        if system.exists(target):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of all files at or below a path."""
    system, target = _open(spark, path)
    found, files = [], system.listFiles(target, True)
    while files.hasNext():
        status = files.next()
        found.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
