"""Each query beside its SQL on the test tables: same columns, types and rows; no pairwise join plans."""

import pytest

from verification import catalog, compare, oracle

QUERIES, ANSWERS = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return compare.duck(folder)


def test_every_answer_belongs_to_a_query():
    assert set(ANSWERS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_equals_sql(name, spark, folder, connection):
    frame = QUERIES[name](spark, folder)
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare.type_differences(frame, connection, ANSWERS[name]) is None
    assert compare.differences(frame, connection, ANSWERS[name]) is None


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = QUERIES["value_picks"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]  # the plan text shows the first of them
    assert pushed.startswith("[IsNotNull(is_rated), IsNotNull(price_range), IsNotNull(aggregate_rating), EqualTo(is_rated,true)")
    assert "rating_text" not in plan
    plan = QUERIES["country_counts"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<country_code:int>" in plan


def test_intermediate_tables_are_not_built_by_pairwise_joins(spark, folder, monkeypatch):
    from venuegrid.functions import components, ranks
    from venuegrid.operators import features, geo, ratings, statistics
    from verification import bindings

    listings = bindings.listing_tables(spark, folder).listings
    plans, write = [], ranks.settle

    def noted(frame, name):
        plans.append((name, frame._jdf.queryExecution().toString()))
        return write(frame, name)

    for module in (components, ranks, features, geo, statistics):
        monkeypatch.setattr(module, "settle", noted)
    ratings.high_votes_low_ratings(listings, leaf_rows=100)
    features.with_cost_category(listings.drop("cost_category"), leaf_rows=100)
    statistics.kruskal_statistics(listings, leaf_rows=100)
    geo.spatial_clusters(bindings.places(spark, folder), 30_000, pair_limit=1)
    assert {"cells", "parts", "cuts", "found", "links", "pointers"} <= {name for name, _ in plans}
    for name, plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
