"""Tables that are published together.

``<root>/versions/<id>/<table>`` holds the files of one build and
``<root>/manifests/<number>.json`` names them. A build is invisible until its manifest is
written, last and as one small file, so readers see all tables of a build or those
of the build before; a job that breaks leaves an unnamed folder behind. Numbers
rise, and a number is taken by creating its file, so two jobs never share one. A
manifest that cannot be read (its writer broke) is passed over.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from venuegrid.sources import files, folders

FORMATS = ("parquet", "csv")


@dataclass(frozen=True)
class Snapshot:
    """One published build; ``tables`` maps names to (path below the root, format, schema as JSON)."""

    root: str
    number: int
    version: str
    source: str
    tables: dict[str, tuple[str, str, str]]

    def path(self, name: str) -> str:
        return f"{self.root}/{self.tables[name][0]}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        _, form, schema = self.tables[name]
        kind = T.StructType.fromJson(json.loads(schema))
        return _LOAD[form](spark, self.path(name), kind)


def _load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


_LOAD = {"parquet": files.load_processed, "csv": files.load_processed_csv, "json": _load_json}
_WRITE = {"parquet": files.write_table, "csv": files.write_csv, "json": files.write_json}


class Draft:
    """A build in progress."""

    def __init__(self, spark: SparkSession, root: str, source: str = ""):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source
        self.version, self._tables = uuid.uuid4().hex[:16], {}

    def add(self, name: str, rows: DataFrame, form: str = "parquet") -> DataFrame:
        """Write one table and read it back."""
        if form not in _WRITE:
            raise ValueError(f"Unknown format {form}; known are {sorted(_WRITE)}")
        path = f"versions/{self.version}/{name}"
        _WRITE[form](rows, f"{self.root}/{path}")
        self._tables[name] = (path, form, rows.schema.json())
        return self._seen(0).table(self.spark, name)

    def publish(self) -> Snapshot:
        """Name the tables written so far; from now on readers find them."""
        number = max(_numbers(self.spark, self.root), default=0) + 1
        while True:
            seen = self._seen(number)
            text = json.dumps({"version": seen.version, "source": seen.source, "tables": seen.tables})
            if folders.create_text(self.spark, _manifest(self.root, number), text):
                return seen
            number += 1

    def _seen(self, number: int) -> Snapshot:
        return Snapshot(self.root, number, self.version, self.source, dict(self._tables))


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifests/{number:012d}.json"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = folders.names(spark, f"{root}/manifests")
    return [int(n[:12]) for n in names if len(n) == 17 and n[:12].isdigit() and n.endswith(".json")]


def history(spark: SparkSession, root: str) -> list[Snapshot]:
    """All published builds, the newest first."""
    root, found = root.rstrip("/"), []
    for number in sorted(_numbers(spark, root), reverse=True):
        try:
            held = json.loads(folders.read_text(spark, _manifest(root, number)))
        except ValueError:
            continue
        found.append(Snapshot(root, number, held["version"], held["source"], {k: tuple(v) for k, v in held["tables"].items()}))
    return found


def latest(spark: SparkSession, root: str) -> Snapshot | None:
    return next(iter(history(spark, root)), None)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete builds older than the ``keep`` newest ones, their manifests first; returns their versions.

    Folders that no manifest names stay, as a job may still be writing them.
    """
    if keep < 1:
        raise ValueError("the newest build must stay")
    old = history(spark, root)[keep:]
    for seen in old:
        folders.delete(spark, _manifest(seen.root, seen.number))
    for seen in old:
        folders.delete(spark, f"{seen.root}/versions/{seen.version}")
    return [seen.version for seen in old]
