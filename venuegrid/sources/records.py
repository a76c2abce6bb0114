"""CSV records with line breaks inside quotes, where the tasks share each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuegrid.session import settle

_MARK = "﻿"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of every block of every file, with counts that hold whether or not the block begins inside quotes.

    ``even``: lines of the block up to this one that begin after an even number of
    quotes, counted within the block; ``line``: lines of the block up to this one.
    A window holds one block, so at most ``spark.sql.files.maxPartitionBytes``.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.length(F.regexp_replace("value", '[^"]', "")) % 2).alias("odd"),
    )
    in_order = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("odd").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("inside", before == 1).withColumn("line", F.row_number().over(in_order))
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    even = F.sum(F.when(~F.col("inside"), 1).otherwise(0)).over(up_to_here)
    return lines.select("file", "block", "line", "value", "odd", "inside", even.alias("even"))


def _opened_blocks(lines: DataFrame) -> DataFrame:
    """One line for each block: whether it begins inside quotes, and how many records begin before it in its file."""
    blocks = lines.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"), F.count_if("inside").alias("starts_open"), F.count_if(~F.col("inside")).alias("starts_closed"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1
    blocks = blocks.withColumn("opened", opened)
    starts = F.when(F.col("opened"), F.col("starts_open")).otherwise(F.col("starts_closed"))
    return blocks.select(
        "file", "block", "opened", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("records_before"),
        (F.sum("odd").over(Window.partitionBy("file")) % 2 == 1).alias("unclosed"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value): the records of all files, numbered from 1 within each file.

    A line break ends a record if an even number of quotes stands before it in the
    file. Quotes are counted for each block of a file; sums over the blocks before
    say whether a block begins inside quotes, so any number of tasks can read one
    file. Only the lines of records with line breaks inside are gathered, by record.
    A carriage return before the end of a record and a byte-order mark before the
    first go; empty records are left out but keep their number. A file that ends
    inside quotes raises. The lines are written once to the work folder, so a lost
    executor or another cut of the files cannot change what a block holds.
    """
    lines = settle(_numbered_lines(spark, path), "csv-lines")
    blocks = settle(_opened_blocks(lines), "csv-blocks")
    begun = F.when(F.col("opened"), F.col("line") - F.col("even")).otherwise(F.col("even"))
    checked = F.when(
        F.col("unclosed"), F.raise_error(F.concat(F.lit("A quote is not closed in "), F.col("file"))).cast("bigint")
    ).otherwise(F.col("records_before") + begun)
    placed = lines.join(blocks, ["file", "block"]).select(
        "file", "block", "line", "value", checked.alias("record"),
        ((F.col("inside") == F.col("opened")) & (F.col("odd") == 0)).alias("complete"),
    )
    single = placed.where("complete").select("file", "record", "value")
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    several = placed.where("not complete").groupBy("file", "record").agg(
        F.array_join(F.transform(parts, lambda part: part["value"]), "\n").alias("value")
    )
    value = F.regexp_replace("value", "\r$", "")
    value = F.when(F.col("record") == 1, F.regexp_replace(value, f"^{_MARK}", "")).otherwise(value)
    return single.unionByName(several).withColumn("value", value).where(F.col("value") != "")


def parsed(rows: DataFrame, header: list[str]) -> DataFrame:
    """The fields of the records below the header, as text; another header or a ragged record raises."""
    names = ", ".join("`{}` STRING".format(c.replace("`", "``")) for c in header)
    options = {"escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    fields = F.from_csv("value", names, options)
    first = F.array(*[fields[c] for c in header]) == F.array(*[F.lit(c) for c in header])
    other = F.raise_error(F.concat(F.lit("Another header in "), F.col("file"))).cast("boolean")
    below = (F.col("record") > 1) | F.when(F.coalesce(first, F.lit(False)), F.lit(False)).otherwise(other)
    return rows.where(below).select(fields.alias("fields")).select("fields.*")
