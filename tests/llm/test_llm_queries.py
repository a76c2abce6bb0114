"""The queries beside their SQL, and what their plans hold."""

import re

import pytest

from venuegrid.llm import queries
from verification import compare

SMALL = "/root/testdata/sf0.001"
QUERIES, ANSWERS = queries.queries(), queries.oracle_sql()


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ANSWERS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_equals_sql(name, spark):
    connection = compare.duck(SMALL)
    frame = QUERIES[name](spark, SMALL)
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare.type_differences(frame, connection, ANSWERS[name]) is None
    assert compare.differences(frame, connection, ANSWERS[name]) is None


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_url_filter", "op6_line_dedup"])
def test_native_operators_run_no_python(name, spark, monkeypatch):
    from venuegrid.llm.scratch import Scratch

    plans, settle, keep = [], Scratch.settle, Scratch.keep

    def noted(write):
        def run(self, frame, title):
            plans.append(frame._jdf.queryExecution().toString())
            return write(self, frame, title)
        return run

    monkeypatch.setattr(Scratch, "settle", noted(settle))
    monkeypatch.setattr(Scratch, "keep", noted(keep))
    plans.append(QUERIES[name](spark, SMALL)._jdf.queryExecution().toString())
    assert len(plans) > 2
    for plan in plans:
        assert not re.search("Python|Pandas|MapInArrow|CartesianProduct|NestedLoopJoin", plan)
