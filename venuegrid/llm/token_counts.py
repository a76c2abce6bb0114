"""Operator 9: exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.llm.bpe import with_digests
from venuegrid.llm.scratch import Scratch

_SPAN = 1024  # lengths of one part of the running sums


def length_histogram(docs: DataFrame, rank_path: str, *, text: str = "text") -> DataFrame:
    """(length, documents): how many texts have how many tokens; a missing text has none."""
    lengths = with_digests(docs.select(docs[f"`{text}`"].alias("text")), rank_path, into="bpe", digests=False)
    return lengths.groupBy(F.col("bpe.n_tokens").alias("length")).agg(F.count("*").alias("documents"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """One line for each length that occurs, read as a context limit.

    ``documents``; ``documents_over`` and ``tokens_over``: of texts longer than the
    limit; ``documents_within``: of texts that fit; ``truncated_tokens``: tokens left
    when every text is cut at the limit; ``tokens``, ``all_documents``: of all texts.
    The histogram is worked out once and written, a line for each length. Sums run
    inside spans of lengths and over the spans, so no task holds all lengths. Missing
    or repeated lengths are added up first; none gives no lines. Texts of any length
    count with their whole length.
    """
    with Scratch(histogram.sparkSession) as scratch:
        lines = scratch.settle(histogram.groupBy("length").agg(F.sum("documents").alias("documents")), "lengths")
        return scratch.keep(_limits(lines.withColumn("span", F.expr(f"length div {_SPAN}"))), "limits")


def _limits(lines: DataFrame) -> DataFrame:
    spans = lines.groupBy("span").agg(F.sum("documents").alias("d"), F.sum(F.col("documents") * F.col("length")).alias("t"))
    later, everything = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    spans = spans.select(
        "span", F.coalesce(F.sum("d").over(later), zero).alias("d_later"), F.coalesce(F.sum("t").over(later), zero).alias("t_later"),
        F.sum("d").over(everything).alias("all_documents"), F.sum("t").over(everything).alias("tokens"),
    )
    above = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = lines.join(spans, "span").select(
        "length", "documents", "all_documents", "tokens",
        (F.coalesce(F.sum("documents").over(above), zero) + F.col("d_later")).alias("documents_over"),
        (F.coalesce(F.sum(F.col("documents") * F.col("length")).over(above), zero) + F.col("t_later")).alias("tokens_over"),
    )
    return over.select(
        "length", "documents", "documents_over", "tokens_over",
        (F.col("all_documents") - F.col("documents_over")).alias("documents_within"),
        (F.col("tokens") - F.col("tokens_over") + F.col("documents_over") * F.col("length")).alias("truncated_tokens"),
        "tokens", "all_documents",
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One line: tokens left when every text is cut at ``limit``, which need not occur as a length; null without texts."""
    fits = F.col("length") <= limit
    own = F.col("documents") * F.least(F.col("length"), F.lit(limit))
    return table.agg(F.sum(own).alias("truncated_tokens"), F.sum(F.when(fits, F.col("documents")).otherwise(0)).alias("documents_within"))


def length_quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the texts do not exceed."""
    wanted = [F.min(F.when(F.col("documents_within") >= F.lit(s) * F.col("all_documents"), F.col("length"))).alias(f"q{k}") for k, s in enumerate(shares)]
    line = table.agg(*wanted)
    return line.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("length")) for k, s in enumerate(shares)])).alias("q")).select("q.*")
