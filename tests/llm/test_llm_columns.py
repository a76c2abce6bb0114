"""Names inside the operators may be names of the input; long texts; pairs are tried once."""

import time

import pytest
from pyspark.sql import functions as F

from venuegrid.llm import decontamination, line_dedup, ngram_join, quality_rules, url_filter

NAMES = ["row", "key", "given", "gone", "lines", "n_symbols", "word_chars", "n_dup_lines", "__counts", "__gone", "__codes", "__row", "__key", "__host",
         "__path", "__rule", "__verdict", "__body", "__bin", "__k", "bin", "host", "m_1", "m_2", "body", "q_1"]


@pytest.fixture
def named(spark):
    rows = [(k, f"one line of text here {k % 3}\nand another {k}", "h", f"https://a{k % 4}.net/es/x{k}") for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, url string").select("*", *[F.lit(n).alias(n) for n in NAMES])


def same(got, plain):
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_internal_names_may_be_columns(named):
    bare = named.select("doc_id", "text", "source", "url")
    for work in (
        lambda df: quality_rules.judged(df, into="q"), lambda df: line_dedup.deduplicated(df, into="q", min_words=4), lambda df: url_filter.judged(df, into="q"),
    ):
        out = work(named)
        assert out.columns == [*named.columns, "q"]
        same(out.select("doc_id", "q"), work(bare).select("doc_id", "q"))
        assert out.where(F.col("__gone") != "__gone").count() == 0 and out.where(F.col("m_1") != "m_1").count() == 0


def test_item_blocks_keep_columns(spark, named):
    items = spark.createDataFrame([(k, f"text here {k % 3} and another {k}") for k in range(6)], "item_id long, text string")
    out = decontamination.with_matches(named, items, into="m", block_bytes=100)
    assert out.columns == [*named.columns, "m"] and out.where("m_1 = 'm_1' and m_2 = 'm_2'").count() == 40
    one = decontamination.with_matches(named.select("doc_id", "text"), items, into="m")
    same(out.select("doc_id", "m.items", decontamination.hit_words("m").alias("n")), one.select("doc_id", "m.items", decontamination.hit_words("m").alias("n")))


def test_one_limit_for_hosts_of_every_size(spark):
    letters = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")
    text = F.concat(letters, F.when(F.col("doc_id") % 100 == 0, "\nshared by one in a hundred").otherwise(""))
    frame = spark.range(4000).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("large").alias("source"))
    assert quality_rules.judged(frame, into="q").where("q.removed_words > 0").count() == 40
    assert quality_rules.judged(frame, into="q", min_documents=40).where("q.removed_words > 0").count() == 0


def test_many_lines_in_one_text(spark):
    frame = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(100_000))), (2, "x")], "doc_id long, text string")
    start = time.perf_counter()
    out = {r.doc_id: r.q for r in line_dedup.deduplicated(frame, into="q").collect()}
    assert (out[1].n_lines, out[1].n_deleted) == (100_000, 0) and time.perf_counter() - start < 240


def test_no_pair_is_verified_twice(spark, monkeypatch):
    from venuegrid.llm.scratch import Scratch

    tried, settle = [], Scratch.settle

    def noted(self, frame, name):
        out = settle(self, frame, name)
        if name == "candidates":
            tried.append({tuple(r) for r in out.collect()})
        return out

    monkeypatch.setattr(Scratch, "settle", noted)
    ngram_join.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len(tried) == 2 and tried[0] and not tried[0] & tried[1]
