"""CSV files with line breaks inside quotes, shared by several tasks."""

import csv
import random

import pytest

from venuegrid.schema import RAW_SCHEMA
from venuegrid.sources import files
from venuegrid.sources.records import records

SIGNS = ["a", "é", ",", '"', "\n", "\r\n", " ", "long word "]


def _write(path, rows, header=RAW_SCHEMA.names, ending="\n", mark=""):
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(mark)
        writer = csv.writer(out, lineterminator=ending)
        writer.writerows([header, *rows])


def _rows(count, seed):
    dice = random.Random(seed)
    width = len(RAW_SCHEMA.names)
    return [
        [str(i), *["x" + "".join(dice.choices(SIGNS, k=dice.randrange(6))) + "x" for _ in range(width - 1)]] for i in range(count)
    ]


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _plain(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_blocks_give_the_rows_of_a_whole_file(spark, small_blocks, tmp_path):
    for k in range(2):
        _write(tmp_path / f"{k}.csv", _rows(120, k))
    got, want = files.load_raw_shared(spark, str(tmp_path)), files.load_raw(spark, str(tmp_path))
    assert got.columns == want.columns
    assert _plain(got) == _plain(want)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_records_over_many_blocks_keep_their_order(spark, small_blocks, tmp_path):
    rows = _rows(3, 5)
    rows[1][1] = "\n".join(f'line "{i}"' for i in range(2000))  # one field over a dozen blocks
    _write(tmp_path / "a.csv", rows)
    got = {r[0]: r[1] for r in files.load_raw_shared(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1] for r in rows}


def test_carriage_returns_marks_and_empty_lines(spark, tmp_path):
    _write(tmp_path / "a.csv", _rows(5, 1), ending="\r\n\r\n", mark="﻿")
    got = records(spark, str(tmp_path)).orderBy("record").collect()
    assert [r["record"] for r in got] == [1, 3, 5, 7, 9, 11]
    assert not any(r["value"].endswith("\r") for r in got)
    assert files.load_raw_shared(spark, str(tmp_path)).count() == 5


def test_a_file_with_its_header_only(spark, tmp_path):
    _write(tmp_path / "a.csv", [])
    assert files.load_raw_shared(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("broken, message", [
    ('1,"open\n', "not closed"), ("1,2\n", "MALFORMED"), (None, "Another header"),
])
def test_broken_files_raise(spark, tmp_path, broken, message):
    _write(tmp_path / "a.csv", _rows(3, 2))
    if broken is None:
        _write(tmp_path / "b.csv", _rows(3, 3), header=RAW_SCHEMA.names[::-1])
    else:
        with open(tmp_path / "a.csv", "a", encoding="utf-8") as out:
            out.write(broken)
    with pytest.raises(Exception, match=message):
        files.load_raw_shared(spark, str(tmp_path)).collect()
