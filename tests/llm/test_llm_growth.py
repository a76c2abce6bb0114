"""Texts of candidates are shuffled once for the join and for the choice of one text a node."""

from venuegrid.llm import ngram_join
from venuegrid.llm.scratch import Scratch


def test_texts_of_candidates_are_shuffled_once(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(3)]
    rows = [(d, texts[d % 3] + (" end" if d % 2 else "")) for d in range(12)]
    plans, write = {}, Scratch.settle

    def noted(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "settle", noted)
    found = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert plans["texts"].count("Exchange hashpartitioning") == 2  # one of the texts, one of the wanted nodes
    assert {r.doc_id: r.component_id for r in found} == {d: d % 3 for d in range(12)}
