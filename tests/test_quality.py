"""Profile counts where missing values, copies or empty groups matter."""

from venuegrid.operators import quality


def one(frame):
    return frame.collect()[0].asDict()


def test_missing_rating_is_invalid_only_in_the_profile_count(spark):
    rows = spark.createDataFrame(
        [(None, 1, 0, 1.0, "a"), (9.0, None, -1, -1.0, " ")],
        "aggregate_rating double, price_range int, votes int, average_cost_for_two double, cuisines string",
    )
    got = one(quality.domain_violations(rows))
    assert (got["invalid_ratings"], got["out_of_range_rating"]) == (2, 1)
    assert (got["invalid_price_ranges"], got["out_of_range_price"]) == (1, 0)
    assert (got["negative_votes"], got["negative_cost"], got["missing_cuisine"]) == (1, 1, 1)


def test_copies_are_found_with_missing_cells(spark):
    rows = [(None, "a"), ("a", None), (None, "a"), ("b", "b"), ("b", "b"), ("b", "b")]
    assert one(quality.exact_duplicate_rows(spark.createDataFrame(rows, "x string, y string"))) == {"exact_duplicate_rows": 3}
    none = spark.createDataFrame([], "x string, y string")
    assert one(quality.exact_duplicate_rows(none)) == {"exact_duplicate_rows": 0}


def test_fences_keep_missing_and_costless_groups(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [(None, 5.0), ("free", 0.0)]
    frame = spark.createDataFrame(rows, "currency string, average_cost_for_two double")
    got = {r["currency"]: r for r in quality.iqr_fences_by_group(frame).collect()}
    assert (got["a"]["iqr_lower_fence"], got["a"]["iqr_upper_fence"], got["a"]["flagged_rows"]) == (-1.0, 7.0, 1)
    assert (got[None]["row_count"], got[None]["iqr_upper_fence"]) == (1, 5.0)
    assert (got["free"]["row_count"], got["free"]["iqr_upper_fence"], got["free"]["flagged_rows"]) == (0, None, 0)


def test_zero_rating_and_its_text(spark):
    rows = [("0", "Not rated"), ("0", "Good"), ("3", "Not rated"), (None, None), ("0", None)]
    frame = spark.createDataFrame(rows, "aggregate_rating string, rating_text string")
    assert one(quality.zero_rating_text_mismatch(frame)) == {"rating_text_mismatches": 3}


def test_constraints(spark):
    listings = spark.createDataFrame([(1,), (1,), (2,)], "restaurant_id long")
    labels = spark.createDataFrame([(1, "x"), (3, "x"), (2, None)], "restaurant_id long, cuisine string")
    got = dict(quality.constraint_checks(listings, labels).collect())
    assert got == {"listing_key_unique": 1, "label_has_listing": 1, "label_not_null": 1}
