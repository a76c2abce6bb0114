"""Operator 2: cross-document line frequency, with basic counts of every text; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.llm import columns as c
from venuegrid.llm.scratch import Scratch

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
MIN_DOCUMENTS = 20
DEPLETED_PERCENT = 50


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside runs of ``window`` words that occur twice or more in the text, the first included.

    Runs are compared by 64-bit codes. Only a text with equal codes is looked at more closely: the places of its
    repeated runs are put in order, and each counts the words up to the next one, ``window`` at most.
    """
    zero = F.lit(0).cast("long")

    def spread(places: Column) -> Column:
        nexts = F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1)))
        own = F.zip_with(places, nexts, lambda a, b: F.when(b.isNull(), F.lit(window)).otherwise(F.least(F.lit(window), b - a)))
        return F.aggregate(own, zero, lambda total, n: total + n)

    def places(runs: Column) -> Column:
        ordered = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return c.let(ordered, lambda s: F.array_sort(F.array_distinct(F.flatten(F.zip_with(
            s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )))))

    def of_codes(codes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(codes) - (window - 1)), lambda i: F.xxhash64(F.slice(codes, i, F.lit(window))))
        return c.let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), zero).otherwise(c.let(places(r), spread)))

    return F.when(F.size(words) < window, zero).otherwise(c.let(F.transform(words, lambda w: F.xxhash64(w)), of_codes))


def normalised(line: Column) -> Column:
    """A-Z lower-cased, digits made equal, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c.lowered(line), "[0-9]", "0"), f"{c.WHITE_CLASS}+", " "))


def base_counts(text: Column) -> list[Column]:
    """The basic counts as columns; a missing text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    worded = F.filter(c.lines(text), lambda line: c.visible(line) != "")
    both = c.let(c.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return [
        both.alias("__counts"),
        F.length(c.visible(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        c.let(worded, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
    ]


def judged(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", into: str = "quality",
    min_documents: int = MIN_DOCUMENTS, depleted_percent: int = DEPLETED_PERCENT,
) -> DataFrame:
    """Every row of ``docs`` with the struct ``into``: counts, verdict, and the codes of lines to remove.

    A normalised line is removed where more than ``min_documents`` documents of
    its host hold it, however many documents the host has. A text that loses
    more than ``depleted_percent`` of its words, or fails the basic rules, is not kept.
    ``cleaned`` turns the codes into the text that is left.

    A missing text is empty, has no lines and fails the basic rules. Rows equal in
    doc_id, host and text are one document and get one result each. A missing host
    is a host of its own; a column named ``into`` is replaced, others may have any name; texts may
    be of any length; empty tables stay empty.
    """
    plain = docs.select(*[docs[f"`{n}`"] for n in docs.columns if n.lower() != into.lower()])
    body, where = F.coalesce(plain[f"`{text}`"].cast("string"), F.lit("")), plain[f"`{host}`"].cast("string")
    row = F.xxhash64(plain[f"`{doc_id}`"].cast("string"), where, body)
    own_lines = F.transform(c.lines(body), lambda line: c.let(normalised(line), lambda x: F.struct(F.xxhash64(x).alias("line"), c.n_words(x).alias("words"))))
    with Scratch(docs.sparkSession) as scratch:
        held = plain.select(row.alias("row"), F.coalesce(F.xxhash64(where), F.lit(0)).alias("host"), F.explode(own_lines).alias("l"))
        held = held.where("l.words > 0").groupBy("row", "host", "l.line").agg(F.sum("l.words").alias("words"))
        held = scratch.settle(held, "lines")
        given = plain.select(row.alias("row"), F.coalesce(F.xxhash64(where), F.lit(0)).alias("host")).groupBy("row", "host").agg(F.count("*").alias("copies"))
        given = scratch.settle(given, "given")
        counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
        common = scratch.settle(counts.select("host", "line"), "common")
        gone = held.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("__gone"), F.collect_list("line").alias("__codes"))
        copies = given.where("copies > 1").select("row", "copies")  # each copy has added the same words
        gone = gone.join(copies, "row", "left").withColumn("__gone", F.expr("__gone div coalesce(copies, 1)")).drop("copies")
        gone = scratch.keep(gone, "removed")
    # the given columns travel as one, so that their names meet no others
    counted = plain.select(row.alias("key"), c.packed(plain), *base_counts(plain[f"`{text}`"].cast("string")))
    joined = counted.join(gone, F.col("key") == F.col("row"), "left")
    n_words, repeat = F.col("__counts.n"), F.col("__counts.r")
    failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    removed = F.coalesce("__gone", F.lit(0).cast("long"))
    return c.unpacked(joined, F.struct(
        n_words.alias("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines"), repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (100 * removed <= depleted_percent * n_words)).alias("kept"),
        removed.alias("removed_words"), F.coalesce("__codes", F.array().cast("array<bigint>")).alias("removed_lines"),
    ), plain.columns, into)


def cleaned(text: str = "text", into: str = "quality") -> Column:
    """The text without the lines to remove; missing texts stay missing."""
    gone = F.col(f"{into}.removed_lines")
    left = F.filter(c.lines(F.col(f"`{text}`")), lambda line: ~F.array_contains(gone, F.xxhash64(normalised(line))))
    return F.when(F.size(gone) == 0, F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
