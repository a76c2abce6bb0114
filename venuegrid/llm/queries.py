"""The operators as queries over the given tables: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuegrid.llm import (
    answers, bpe, chat, decontamination, interpolation, line_dedup, ngram_join, quality_rules, simhash, structure, token_counts, toxicity,
    url_filter, whitening,
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return answers.oracle_sql()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_url_filter(spark, sf):
    return url_filter.judged(table(spark, sf, "pages").select("page_id", "url"), into="v").select("page_id", "v.host", "v.path", "v.rule", "v.verdict")


@query
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    held_out = toxicity.fold_of(F.col("doc_id")) == toxicity.TEST_FOLD
    score = F.col("t.score")
    predicted = (score >= toxicity.THRESHOLD).cast("int")
    return toxicity.scored(docs, model, into="t").select("doc_id", held_out.alias("held_out"), score.alias("score"), predicted.alias("predicted"))


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op5_byte_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, rank_path(), into="bpe").select("doc_id", "bpe.*")


@query
def op8_deleted_interpolation(spark, sf):
    return interpolation.scored(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op9_token_counts(spark, sf):
    return token_counts.limit_table(token_counts.length_histogram(table(spark, sf, "documents"), rank_path()))


@query
def op1_chat_format(spark, sf):
    turns = chat.repaired(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.select("conv_id", "turn", "role", "role_out", "action", "inserted_before", "inserted_after", "cost", F.sha2("fragment", 256).alias("fragment_sha256"))


@query
def op2_quality_rules(spark, sf):
    return quality_rules.judged(table(spark, sf, "documents").select("doc_id", "text", "source"), into="q").select(
        "doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept", "q.removed_words",
    )


@query
def op6_line_dedup(spark, sf):
    return line_dedup.deduplicated(table(spark, sf, "documents").select("doc_id", "text"), into="l").select(
        "doc_id", "l.n_lines", "l.n_deleted", F.sha2("l.text", 256).alias("text_sha256"),
    )


@query
def op7_ngram_join(spark, sf):
    return ngram_join.similar_groups(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op10_decontamination(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.with_matches(docs, table(spark, sf, "benchmark"), into="m")
    hit, items = decontamination.hit_words("m"), F.col("m.items")
    return found.select(
        "doc_id", F.col("m.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query
def op11_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op12_simhash(spark, sf):
    return simhash.near_copies(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op13_structure_repair(spark, sf):
    return structure.audited(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
