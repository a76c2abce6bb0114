"""Run queries beside their SQL and compare: ``python -m verification.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from venuegrid.session import local_session
from verification import catalog, oracle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(lines, key=lambda line: [(v is None, str(type(v)), str(v)) for v in line])


_SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_differences(spark_frame, connection, sql: str) -> str | None:
    want = {name: str(kind) for name, kind, *_ in connection.execute(f"DESCRIBE {sql}").fetchall()}
    kinds = {f.name: _SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_frame.schema}
    odd = {c: (k, want.get(c)) for c, k in kinds.items() if want.get(c) != k}
    return f"types differ: {odd}" if odd else None


def differences(spark_frame, connection, sql: str) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    got = _sorted_rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    cursor = connection.execute(sql)
    want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows <> {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} of {len(want[1])} rows differ, first {bad[0]}" if bad else None


def main(folder: str, names: list[str]) -> int:
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection, answers, failed = duck(folder), oracle.oracle_sql(), []
    for name, run in catalog.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in answers:
                problem = type_differences(frame, connection, answers[name])
                problem = problem or differences(frame, connection, answers[name])
            else:
                problem = f"(no SQL, {frame.count()} rows)"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem and not problem.startswith("(no SQL"):
            failed.append(name)
        print(f"{name:32s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    arguments = sys.argv[1:]
    main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:])
