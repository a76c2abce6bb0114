"""A corpus pipeline: toxic documents go, repeated line runs and near copies go, test passages go, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuegrid.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from venuegrid.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of documents that came in."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more leave the texts; documents of which nothing is left go; n_chars follows the text."""
    out = line_dedup.without_copies(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id."""
    return ngram_join.one_of_each_group(docs)


def remove_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a test item."""
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.with_digests(docs.select("doc_id", "text"), path, into="bpe").select("doc_id", "bpe.*")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", remove_test_passages),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # SQL can express neither the toxicity model nor the encoding


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            docs = scratch.keep(out, name) if k == len(STAGES) - 1 else scratch.settle(out, name)
    return docs
