"""Published builds, the jobs' command lines, and what the report and the charts read."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from venuegrid.operators import cleaning
from venuegrid.operators.report import quality_report
from venuegrid.plans import charts, jobs, publish
from venuegrid.schema import SOURCE_HEADERS
from venuegrid.session import scratch, settle, work_root
from venuegrid.sources import folders, snapshots

ROOT = Path(__file__).resolve().parents[1]


def line(k, cuisines="Thai, Pizza", city="A", currency="X", cost="100", rating="4.1"):
    return f'{k},"Inn\n{k}",1,{city},,,,10,20,"{cuisines}",{cost},{currency},Yes,No,No,No,2,{rating},Green,Good,12'


def write_raw(path, *lines):
    path.write_text("\n".join([",".join(SOURCE_HEADERS), *lines]) + "\n")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def left_behind(spark):
    folder = Path(work_root(spark).removeprefix("file:")) / "venuegrid"
    return sorted(p.name for app in folder.iterdir() for p in app.iterdir()) if folder.exists() else []


def test_a_job_that_breaks_between_the_tables_leaves_the_pair_before(spark, tmp_path, monkeypatch):
    out, raw = str(tmp_path / "out"), write_raw(tmp_path / "raw.csv", line(1))
    before, _ = publish.clean_and_write(spark, raw, out)
    kept = rows(before.listings), rows(before.labels)
    write_raw(tmp_path / "raw.csv", line(1), line(2), line(3))

    def broken(stored):
        raise RuntimeError("lost between the tables")

    monkeypatch.setattr(publish, "explode_labels", broken)
    with pytest.raises(RuntimeError, match="between"):
        publish.clean_and_write(spark, raw, out)
    seen = publish.load_tables(spark, out)
    assert (rows(seen.listings), rows(seen.labels)) == kept and len(snapshots.history(spark, out)) == 1
    monkeypatch.undo()
    assert publish.clean_and_write(spark, raw, out)[0].listings.count() == 3
    # readers of the build before still find their files
    assert (rows(before.listings), rows(before.labels)) == kept


def test_running_again_changes_nothing_until_the_source_does(spark, tmp_path):
    out, raw = str(tmp_path / "out"), write_raw(tmp_path / "raw.csv", line(1), line(2))
    for _ in range(2):
        publish.clean_and_write(spark, raw, out)
    (first,) = snapshots.history(spark, out)
    publish.clean_and_write(spark, raw, out, form="csv")
    assert len(snapshots.history(spark, out)) == 2 and snapshots.latest(spark, out).version != first.version
    for k in range(3, 6):
        write_raw(tmp_path / "raw.csv", *[line(j) for j in range(k)])
        publish.clean_and_write(spark, raw, out)
    assert [s.number for s in snapshots.history(spark, out)] == [5, 4]
    assert len(folders.names(spark, f"{out}/versions")) == 2


def test_both_forms_hold_the_same_rows(spark, tmp_path):
    raw = write_raw(tmp_path / "raw.csv", line(1), line(2, cuisines="", city="", cost="0"), line(3, currency="", rating="x"))
    pairs = [publish.clean_and_write(spark, raw, str(tmp_path / form), form)[0] for form in publish.FORMATS]
    assert rows(pairs[0].listings) == rows(pairs[1].listings) and rows(pairs[0].labels) == rows(pairs[1].labels)
    assert pairs[0].listings.dtypes == pairs[1].listings.dtypes
    assert list((tmp_path / "csv" / "versions").glob("*/listings/*.csv"))
    with pytest.raises(ValueError, match="Unknown format"):
        publish.clean_and_write(spark, raw, str(tmp_path / "no"), "orc")
    assert snapshots.latest(spark, str(tmp_path / "no")) is None


def test_numbers_are_taken_once_and_broken_manifests_are_passed_over(spark, tmp_path):
    root = str(tmp_path / "root")
    drafts = [snapshots.Draft(spark, root, str(k)) for k in range(2)]
    for k, draft in enumerate(drafts):
        draft.add("t", spark.range(k + 1))
    assert snapshots.latest(spark, root) is None
    (tmp_path / "root" / "manifests").mkdir(parents=True)
    (tmp_path / "root" / "manifests" / f"{3:012d}.json").write_text('{"version": "ab')
    taken = snapshots._numbers
    snapshots._numbers = lambda *_: []  # both writers saw an empty folder
    try:
        published = [draft.publish() for draft in drafts]
    finally:
        snapshots._numbers = taken
    assert [p.number for p in published] == [1, 2]
    assert snapshots.latest(spark, root).table(spark, "t").count() == 2
    with pytest.raises(ValueError, match="stay"):
        snapshots.expire(spark, root, 0)


def test_jobs_leave_nothing_in_the_work_folder(spark, tmp_path):
    before = left_behind(spark)
    raw = write_raw(tmp_path / "raw.csv", *[line(k, cost=str(100 + k % 7), rating=str(1 + k % 4)) for k in range(40)])
    tables, _ = publish.clean_and_write(spark, raw, str(tmp_path / "out"))
    publish.write_report_tables(tables, str(tmp_path / "reports"))
    publish.write_chart_tables(tables, str(tmp_path / "reports"))
    publish.ensure_materialised(spark, str(tmp_path / "again"), lambda: cleaning.clean(settle(spark.read.csv(raw, header=True, multiLine=True, escape='"'), "raw")))
    with pytest.raises(RuntimeError), scratch(spark):
        settle(spark.range(3), "lost")
        raise RuntimeError
    assert left_behind(spark) == before


def test_the_report_reads_the_source_three_times_at_most(spark, tmp_path, monkeypatch):
    from venuegrid.operators import report

    path = str(tmp_path / "rows")
    spark.createDataFrame([tuple("1" for _ in SOURCE_HEADERS)] * 3, ",".join(f"`{h}` string" for h in SOURCE_HEADERS)).write.parquet(path)
    plans, write = [], report.settle
    monkeypatch.setattr(report, "settle", lambda frame, name: plans.append(frame) or write(frame, name))
    plans.append(quality_report(spark.read.parquet(path)))
    scans = sum(len(re.findall(rf"FileScan parquet [^\n]*{re.escape(path)}\b", p._jdf.queryExecution().executedPlan().toString())) for p in plans)
    assert 1 <= scans <= 3
    assert all("collect_list" not in p._jdf.queryExecution().toString() for p in plans)


def test_the_report_of_an_empty_source(spark):
    none = spark.createDataFrame([], ",".join(f"`{h}` string" for h in SOURCE_HEADERS))
    held = {(r.section, r.subject): r.amount for r in quality_report(none).where("measure = 'count' or measure = 'rows'").collect()}
    assert held["counter", "rows"] == held["counter", "exact_duplicate_rows"] == held["numeric_fence", "votes"] == 0


def test_missing_ids_and_copies_count_as_in_the_source(spark):
    def raw(k, city):
        return tuple(k if h == "Restaurant ID" else city if h == "City" else "1" for h in SOURCE_HEADERS)

    frame = spark.createDataFrame([raw("1", "a")] * 3 + [raw("1", "b"), raw(None, "a"), raw(None, None), raw("2", "a")], ",".join(f"`{h}` string" for h in SOURCE_HEADERS))
    held = {r.subject: r.amount for r in quality_report(frame).where("section = 'counter'").collect()}
    assert (held["exact_duplicate_rows"], held["unique_restaurant_ids"], held["duplicate_restaurant_ids"]) == (2, 2, 4)


def test_charts_read_both_tables_once(spark, tmp_path, monkeypatch):
    raw = write_raw(tmp_path / "raw.csv", *[line(k, cost=str(100 + k % 7), rating=str(1 + k % 4)) for k in range(60)])
    tables, _ = publish.clean_and_write(spark, raw, str(tmp_path / "out"))
    plans, write = [], charts.settle
    monkeypatch.setattr(charts, "settle", lambda frame, name: plans.append(frame) or write(frame, name))
    lines = charts.chart_lines(tables.listings, tables.labels)
    text = [p._jdf.queryExecution().executedPlan().toString() for p in [*plans, lines]]
    assert sum(t.count(str(tmp_path / "out")) > 0 for t in text) == 2 and all(len(re.findall("FileScan", t)) == 1 for t in text[:2])
    held = {(r.chart, r.label): r.restaurants for r in lines.where("series is null and label is not null").collect()}
    assert held["price_range_distribution", "2"] == 60 and held["price_range_distribution", "1"] == 0 and held["top_cuisines", "Thai"] == 60
    assert lines.where("chart = 'geographic_distribution'").agg(F.sum("restaurants")).head()[0] == 60


def test_the_commands_run_from_a_shell(tmp_path):
    raw = write_raw(tmp_path / "raw.csv", *[line(k, cost=str(100 + k % 7), rating=str(1 + k % 4)) for k in range(30)])
    environment = os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}

    def run(script, *arguments):
        done = subprocess.run([sys.executable, str(ROOT / script), *map(str, arguments)], env=environment, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stdout

    assert "Output: 30 listings; 60 label rows" in run("clean_listings.py", raw, tmp_path / "out", "--format", "csv")
    assert "charts:" in run("write_reports.py", tmp_path / "out", tmp_path / "reports")
    assert {p.name for p in (tmp_path / "reports").iterdir()} == {"correlation_tests", "group_comparison_tests", "cuisine_opportunities", "high_votes_low_ratings", "charts"}


def test_command_lines(spark, tmp_path, capsys):
    raw = write_raw(tmp_path / "raw.csv", line(1), line(2, cuisines=""))
    said = jobs.clean_listings([raw, str(tmp_path / "out")], spark)
    assert said[0] == "Source: 2 rows; 21 columns" and said[3] == "Rows without labels: 1" and capsys.readouterr().out.startswith("Source")
    with pytest.raises(FileNotFoundError, match="Run the cleaning job first"):
        jobs.write_reports([str(tmp_path / "none"), str(tmp_path / "reports")], spark)
