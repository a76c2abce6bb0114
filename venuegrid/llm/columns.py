"""Column expressions on words and lines that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words, and Java's and RE2's way to write it.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` holds lambdas that refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def visible(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, WHITE, "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def packed(df: DataFrame) -> Column:
    """All columns as the one column ``given``, whose fields' names meet no others."""
    return F.struct(*[df[f"`{n}`"] for n in df.columns]).alias("given")


def unpacked(df: DataFrame, made: Column, names: list[str], into: str) -> DataFrame:
    """The fields of ``given`` under their names, and ``made`` as ``into``."""
    return df.select("given", made.alias("made")).select(*[F.col("given").getField(n).alias(n) for n in names], F.col("made").alias(into))
