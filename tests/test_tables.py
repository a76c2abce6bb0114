"""Files, the cleaning job, slices and scores."""

import pytest

from venuegrid.operators import cleaning, features, pricing, scoring, slicing
from venuegrid.plans import publish
from venuegrid.schema import RAW_SCHEMA, SOURCE_HEADERS
from venuegrid.sources import files

LISTING = "restaurant_id long, currency string, aggregate_rating double, is_rated boolean, price_range int, country_code int, city string"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "raw.csv"
    lines = [
        ",".join(SOURCE_HEADERS),
        '1,"The ""Old"" Inn, Ltd",1,A,,,,10,20,"Thai, Pizza",100,X,Yes,No,No,No,2,4.1,Green,Good,12',
        "2,NA,1,B,N/A,null,,0,0,,0,X,No,Yes,No,No,1,0,White,Not rated,0",
    ]
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    return str(path)


def test_raw_csv(spark, csv):
    rows = files.load_raw(spark, csv).orderBy("`Restaurant ID`").collect()
    assert [r["Restaurant ID"] for r in rows] == ["1", "2"]
    assert rows[0]["Restaurant Name"] == 'The "Old" Inn, Ltd' and rows[0]["Cuisines"] == "Thai, Pizza"
    assert (rows[1]["Restaurant Name"], rows[1]["Address"], rows[1]["Locality"]) == (None, None, None)


def test_missing_files_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Dataset not found"):
        files.load_raw(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError, match="Run the cleaning job"):
        files.load_processed(spark, str(tmp_path / "none"))


def test_cleaning_job(spark, csv, tmp_path):
    out = str(tmp_path / "out")
    tables, report = publish.clean_and_write(spark, csv, out)
    assert tables.listings.count() == 2
    assert {(r["restaurant_id"], r["cuisine"]) for r in tables.labels.collect()} == {(1, "Thai"), (1, "Pizza")}
    held = {(r.section, r.subject, r.measure): r.amount if r.amount is not None else r.content for r in report.collect()}
    assert [held["counter", c, "count"] for c in ("rows", "unrated_rows", "invalid_coordinate_rows", "columns")] == [2, 1, 1, 21]
    assert held["column", "cuisines", "missing"] == 1 and held["currency", "X", "rows"] == 2 and held["country_currency", "1", "value"] == "X"
    assert publish.load_tables(spark, out).listings.where("cost_category = 'Unknown'").count() == 1
    assert publish.load_quality_report(spark, out).count() == report.count()


def test_tables_are_built_once(spark, csv, tmp_path):
    out, calls = str(tmp_path / "once"), []

    def build():
        calls.append(1)
        return cleaning.clean(files.load_raw(spark, csv))

    for _ in range(2):
        assert publish.ensure_materialised(spark, out, build).labels.count() == 2
    assert len(calls) == 1


def test_csv_round_trip_keeps_missing_and_quotes(spark, csv, tmp_path):
    cleaned = cleaning.clean(files.load_raw(spark, csv))
    files.write_csv(cleaned, str(tmp_path / "csv"))
    back = files.load_processed_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, cleaned.collect()), key=str)


def test_default_slice_drops_the_highest_rating_and_missing_bands(spark):
    rows = [(1, "a", 5.0, True, 1, 1, "x"), (2, "a", 4.9, True, 1, 1, "x"), (3, "a", 3.0, True, None, 1, "x"), (4, "a", None, False, 1, 1, "x")]
    assert [r[0] for r in slicing.slice_listings(spark.createDataFrame(rows, LISTING)).collect()] == [2]


def test_one_label_currency_scores_differ_between_the_two_scores(spark):
    listings = spark.createDataFrame([(i, "a", 4.0, True, 1, 1, "x") for i in range(5)] + [(9, "a", 1.0, True, 1, 1, "x")], LISTING)
    labels = spark.createDataFrame([(i, "a", "Thai", 4.0, 1) for i in range(5)], "restaurant_id long, currency string, cuisine string, aggregate_rating double, votes long")
    first = scoring.label_opportunities(listings, labels).collect()[0]
    second = scoring.label_opportunities_sql(listings, labels).collect()[0]
    assert first["opportunity_score"] == 0.0 and first["presence_percentile"] == 1.0
    assert second["opportunity_score"] == second["rating_gap"] == pytest.approx(0.5)


def test_mean_cost_needs_one_currency(spark):
    schema = "currency string, average_cost_for_two double"

    def status(rows):
        line = pricing.single_currency_mean(spark.createDataFrame(rows, schema)).collect()[0]
        return line["status"], line["mean_cost"]

    assert status([("a", 10.0), ("a", 20.0), ("a", 0.0)]) == ("Single currency", 15.0)
    assert status([("a", 10.0), ("b", 20.0)]) == ("Multiple currencies", None)
    assert status([("a", 0.0)]) == ("N/A", None)
    assert status([(None, 5.0)]) == ("N/A", None)
    assert status([]) == ("N/A", None)


def test_a_cost_beyond_the_decimal_type_does_not_fail(spark):
    frame = spark.createDataFrame([("a", 1e25), ("a", 1.0)], "currency string, average_cost_for_two double")
    assert pricing.single_currency_mean(frame).collect()[0]["mean_cost"] == pytest.approx(5e24)


def test_labels_of_listings_add_up(spark):
    rows = [tuple("a, b,c" if h == "Cuisines" else "1" for h in SOURCE_HEADERS)]
    cleaned = cleaning.standardise(spark.createDataFrame(rows, RAW_SCHEMA))
    counted = features.with_label_count(cleaned).collect()[0]["cuisine_count"]
    assert features.explode_labels(cleaned).count() == counted == 3


def test_raw_columns_are_found_by_name(spark, tmp_path):
    from venuegrid.schema import SOURCE_HEADERS

    header = ["Note", *reversed(SOURCE_HEADERS), "Other"]
    line = ["first\nsecond", *[f"v {h}" for h in reversed(SOURCE_HEADERS)], "NA"]
    path = tmp_path / "shuffled.csv"
    path.write_text(",".join(header) + "\n" + ",".join(f'"{x}"' for x in line) + "\n")
    rows = files.load_raw(spark, str(path))
    assert rows.columns == [*SOURCE_HEADERS, "Note", "Other"]
    row = rows.collect()[0]
    assert [row[h] for h in SOURCE_HEADERS] == [f"v {h}" for h in SOURCE_HEADERS] and row["Note"] == "first\nsecond"
    (tmp_path / "lacking.csv").write_text("City,Currency\nx,y\n")
    with pytest.raises(ValueError, match="Votes"):
        files.load_raw(spark, str(tmp_path / "lacking.csv"))
    (tmp_path / "ragged.csv").write_text(",".join(SOURCE_HEADERS) + "\na,b,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.load_raw(spark, str(tmp_path / "ragged.csv")).collect()


def test_quoted_line_breaks_survive_a_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a\nb, \"c\""), (2, None)], "restaurant_id long, city string")
    files.write_csv(frame, str(tmp_path / "out"))
    back = files.load_processed_csv(spark, str(tmp_path / "out"), frame.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "a\nb, \"c\""), (2, None)]


def test_a_clean_configuration_gets_a_work_folder(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "from venuegrid.session import local_session, settle, discard\n"
        "spark = local_session('2')\n"
        "out = settle(spark.range(5), 'x')\n"
        "assert out.count() == 5\n"
        "folder = out.inputFiles()[0].rsplit('/', 1)[0].removeprefix('file:')\n"
        "discard(out)\n"
        "import os; assert not os.path.exists(folder)\n"
    )
    environment = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", code], check=True, env=environment, timeout=120)
