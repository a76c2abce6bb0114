"""String and label expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def snake_case(name: str) -> str:
    """``Average Cost for two`` -> ``average_cost_for_two``."""
    return "_".join(re.findall(r"[A-Za-z0-9]+", name)).lower()


def strip(c: Column) -> Column:
    """Remove every kind of Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def yes_no(c: Column) -> Column:
    """``Yes``, ``No`` or null, whatever the case or padding."""
    word = F.lower(strip(c))
    return F.when(word == "yes", F.lit("Yes")).when(word == "no", F.lit("No"))


def to_number(c: Column) -> Column:
    """Text to double; the cast itself ignores outer blanks, other text gives null.

    Letters other than an exponent's are ruled out first: a Java cast would also
    accept a type suffix (``1d``), hexadecimal and the names of special values.
    A number beyond the doubles (``1e999``) is missing too.
    """
    text = c.cast("string")
    number = text.try_cast("double")
    return F.when(~text.rlike("[a-df-zA-DF-Z]") & (F.abs(number) < float("inf")), number)


def label_array(c: Column) -> Column:
    """Trimmed, non-blank parts of a comma-separated text; null stays null."""
    parts = F.transform(F.split(c, ","), strip)
    return F.filter(parts, lambda part: part != "")


def label_count(c: Column) -> Column:
    return F.coalesce(F.size(label_array(c)), F.lit(0))
