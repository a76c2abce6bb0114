"""Operator 6: repeated runs of lines, by a suffix array over line ids; DataFrame functions only.

Prefix doubling: the rank of a place at level k is its place in the order of all
suffixes by their first 2^k lines, and places with equal ranks are one interval of
suffixes with that common prefix. Ranks of level k + 1 come from the pairs of ranks
2^k lines apart. Places whose prefix is unique leave, so only repeated text goes
on. A run of any length is named by the ranks of its two overlapping halves, and
all but its first occurrence are later copies.

It is enough to test the shortest runs with ``min_words`` words, from each line on
and up to each line: every line of a longer repeated run lies in one of them that
is inside that run. So a run has at most ``min_words`` lines, which ends the doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuegrid.llm import columns as c
from venuegrid.llm.scratch import Scratch

MIN_WORDS = 50
FEW = 4  # lines that mostly hold so many words


def ranked(scratch: Scratch, keys: DataFrame, names: list[str]) -> DataFrame:
    """(names, rank) of the keys that occur more than once; the rank is the number of repeated places before them in key order.

    Keys are range-sorted over the tasks; each task counts on from the totals of those before it.
    """
    counts = keys.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
    dealt = scratch.settle(counts.repartitionByRange(*names).withColumn("part", F.spark_partition_id()), "ranks")
    totals = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*names)) - F.col("n")
    return dealt.withColumn("inside", inside).join(before, "part").select(*names, (F.col("inside") + F.col("before")).alias("rank"))


def _windows(words: Column, least: int) -> Column:
    """(start, size) of the shortest runs with ``least`` words, from each line and up to each line."""
    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))
        return F.aggregate(part, start, lambda acc, w: F.when(acc["s"] >= least, acc).otherwise(F.struct((acc["s"] + w).alias("s"), (acc["n"] + 1).alias("n"))))

    def size(part: Column) -> Column:
        def checked(acc: Column, other: Column) -> Column:
            return F.when(acc["s"] >= least, acc["n"]).otherwise(other)

        return c.let(part, lambda p: c.let(fold(F.slice(p, 1, FEW)), lambda few: checked(few, c.let(fold(p), lambda acc: checked(acc, F.lit(0))))))

    after = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.when(w >= least, F.lit(1)).otherwise(size(F.slice(words, i + 1, F.lit(least)))).alias("size")))
    first = lambda i: F.greatest(F.lit(1), i - (least - 2))
    before = F.transform(words, lambda w, i: c.let(
        F.when(w >= least, F.lit(1)).otherwise(size(F.reverse(F.slice(words, first(i), i + 2 - first(i))))),
        lambda n: F.struct((i - n + 1).alias("at"), n.alias("size")),
    ))
    # one number for each run, as distinct numbers are found by hashing and distinct structs by comparing all pairs
    found = F.transform(F.filter(F.concat(after, before), lambda x: x["size"] > 0), lambda x: x["at"].cast("long") * (least + 1) + x["size"])
    return F.transform(F.array_distinct(found), lambda v: F.struct(
        F.floor(v / F.lit(least + 1)).cast("int").alias("at"), (v % (least + 1)).cast("int").alias("size"),
    ))


def _log2(size: int) -> int:
    return size.bit_length() - 1


def deletions(scratch: Scratch, docs: DataFrame, min_words: int) -> DataFrame:
    """(row, lines): of each document the numbers of lines to delete, counting lines with words from 0.

    ``docs`` has ``row``, ``doc_id`` and ``text``, without missing texts.
    """
    worded = F.filter(F.transform(c.lines(F.col("text")), lambda line: F.struct(F.xxhash64(line).alias("h"), c.n_words(line).alias("w"))), lambda x: x["w"] > 0)
    counts = F.transform("ls", lambda x: x["w"])
    sequences = docs.select("row", "doc_id", worded.alias("ls")).select(
        "row", "doc_id", F.transform("ls", lambda x: x["h"]).alias("ids"), c.let(counts, lambda w: _windows(w, min_words)).alias("runs"),
    )
    sequences = scratch.settle(sequences.dropDuplicates(["row"]), "sequences")  # copies of a row would multiply in every join
    places = sequences.select("row", F.posexplode("ids").alias("i", "line"))
    runs = sequences.select("row", "doc_id", F.explode("runs").alias("x")).select("row", "doc_id", F.col("x.at").alias("at"), F.col("x.size").alias("size"))

    level = scratch.settle(places.join(ranked(scratch, places, ["line"]), "line").select("row", "i", "rank"), "level")
    found = None
    for k in range(_log2(min_words) + 1):
        if not level.head(1):
            break
        low, high = 1 << k, (2 << k) - 1
        own = runs.where(F.col("size").between(low, high)).join(level.withColumnsRenamed({"i": "at", "rank": "a"}), ["row", "at"])
        own = own.withColumn("end", F.col("at") + F.col("size") - low)
        own = own.join(level.withColumnsRenamed({"i": "end", "rank": "b"}), ["row", "end"])
        own = scratch.settle(own.select("row", "doc_id", "at", "size", "a", "b"), "runs")
        place = F.struct("doc_id", "row", "at")
        first = own.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        first = scratch.settle(first, "first")  # so that a run of very many copies is added up early and split in the join
        later = own.join(first, ["size", "a", "b"]).where(F.struct("doc_id", "row", "at") != F.col("first")).select("row", "at", "size")
        later = scratch.settle(later, "copies")
        found = later if found is None else found.unionByName(later)
        if high >= min_words:
            break
        step = level.withColumn("to", F.col("i") + low).join(level.select("row", F.col("i").alias("to"), F.col("rank").alias("next")), ["row", "to"])
        step = scratch.settle(step.select("row", "i", F.col("rank").alias("left"), F.col("next").alias("right")), "pairs")
        level = scratch.settle(step.join(ranked(scratch, step, ["left", "right"]), ["left", "right"]).select("row", "i", "rank"), "level")
    if found is None:
        return runs.select("row", F.array("at").alias("lines")).limit(0)
    spots = found.select("row", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("line"))
    return spots.groupBy("row").agg(F.collect_set("line").alias("lines"))


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", into: str = "lines", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with the struct ``into``: ``n_lines`` (lines with words), ``n_deleted``, and the ``text`` left.

    A line is deleted if it lies in a run of lines, blank ones apart, of at least
    ``min_words`` words that also begins at an earlier place: in a document with a
    smaller doc_id (missing ids first, then a fixed order), or before in the same
    one. Lines are equal when all their characters are. The first occurrence stays.

    A missing or empty text has no lines and stays as it is. Rows equal in doc_id
    and text are one document and get one result each. A column named ``into`` is
    replaced; others may have any name. Texts may have any number of lines. An empty table gives an empty result.
    """
    plain = docs.select(*[docs[f"`{n}`"] for n in docs.columns if n.lower() != into.lower()])
    body = plain[f"`{text}`"].cast("string")
    row = F.xxhash64(plain[f"`{doc_id}`"].cast("string"), body)
    given = plain.select(row.alias("row"), plain[f"`{doc_id}`"].alias("doc_id"), body.alias("text")).where("text is not null")
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.keep(deletions(scratch, given, min_words), "deletions")
    # hashing the small side keeps the texts unsorted; the plan is the same at every size
    gone = gone.select(F.col("row").alias("key"), F.col("lines").alias("gone")).hint("shuffle_hash")
    # the given columns travel as one, so that their names meet no others
    held = plain.select(row.alias("row"), c.packed(plain))
    joined = held.join(gone, F.col("row") == F.col("key"), "left")
    body = F.col("given").getField(text).cast("string")

    def left(ls: Column) -> Column:
        worded = F.filter(F.transform(ls, lambda line, i: F.when(c.visible(line) != "", i)), lambda i: i.isNotNull())
        return c.let(worded, lambda at: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.transform(F.col("gone"), lambda n: F.get(at, n))), lambda i: F.get(ls, i),
        ), "\n"))

    n_lines = F.size(F.filter(c.lines(F.coalesce(body, F.lit(""))), lambda line: c.visible(line) != "")).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    rest = F.when(F.col("gone").isNull(), body).otherwise(c.let(c.lines(body), left))
    return c.unpacked(joined, F.struct(n_lines.alias("n_lines"), n_gone.alias("n_deleted"), rest.alias("text")), plain.columns, into)


def without_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with later copies deleted from the texts; a document that loses every line goes."""
    into = "__lines"
    found = deduplicated(docs, doc_id=doc_id, text=text, into=into, **options)
    kept = found.where((F.col(f"{into}.n_deleted") == 0) | (F.col(f"{into}.n_deleted") < F.col(f"{into}.n_lines")))
    return kept.select(*[(F.col(f"{into}.text") if n == text else F.col(f"`{n}`")).alias(n) for n in docs.columns])
