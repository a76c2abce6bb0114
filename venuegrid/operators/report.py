"""The quality report of the source rows as long lines, from three passes over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.joins import null_safe_join
from venuegrid.functions.ranks import LEAF_ROWS, quantiles
from venuegrid.operators import quality
from venuegrid.operators.cleaning import coerce_numeric, snake_case_columns
from venuegrid.schema import NUMERIC_TYPES, SERVICE_FLAGS
from venuegrid.session import settle

LINE = {"section": "string", "subject": "string", "measure": "string", "amount": "bigint", "number": "double", "content": "string"}
#: The source's rule violations that the report counts.
REPORTED = ("zero_cost_rows", "negative_cost", "unrated_rows", "invalid_ratings", "invalid_price_ranges", "negative_votes")
_FENCED = ("aggregate_rating_rated_only", "votes")


def quality_report(raw: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(section, subject, measure, amount, number, content) lines that profile source rows.

    ``counter`` lines count rows, ids, copies and violations; ``column`` lines give
    position, type and missing cells of each column; ``currency``, ``country_currency``
    and ``flag`` lines the values that occur; ``cost_fence`` lines (by currency) and
    ``numeric_fence`` lines the quartile fences with the rows they judge and flag. A
    missing value of a grouping column is a missing subject. No line holds a list, so
    its size does not grow with the rows.
    """
    text = snake_case_columns(raw)
    typed = coerce_numeric(text.withColumns({f"_raw_{c}": F.col(c) for c in NUMERIC_TYPES}))
    cells = settle(_cells(typed), "report-cells")
    parts = [_columns(text), _counters(typed, text.columns), _copies(text), _values(cells), _fences(cells, leaf_rows)]
    return reduce(DataFrame.unionByName, [_lines(p) for p in parts])


def _lines(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in LINE.items()])


def _columns(text: DataFrame) -> DataFrame:
    held = [("column", f.name, m, n, c) for k, f in enumerate(text.schema, 1) for m, n, c in (("position", k, None), ("dtype", None, f.dataType.simpleString()))]
    return text.sparkSession.createDataFrame([*held, ("counter", "columns", "count", len(text.columns), None)], "section string, subject string, measure string, amount long, content string")


def _counters(typed: DataFrame, columns: list[str]) -> DataFrame:
    found = quality.violations()
    counts = {f"counter|{c}|count": F.count_if(found[c]) for c in REPORTED}
    counts |= {
        "counter|rows|count": F.count("*"),
        "counter|invalid_coordinate_rows|count": F.count_if(quality.bad_coordinate()),
        "counter|rating_text_mismatches_for_zero_ratings|count": F.count_if(quality.rating_and_text_differ(F.col("aggregate_rating"))),
    }
    counts |= {f"column|{c}|missing": F.count_if(F.col(f"_raw_{c}" if c in NUMERIC_TYPES else c).isNull()) for c in columns}
    row = typed.agg(*[count.alias(name) for name, count in counts.items()])
    return _named(row.unpivot([], row.columns, "cell", "amount"))


def _named(df: DataFrame) -> DataFrame:
    parts = [F.split_part("cell", F.lit("|"), F.lit(k)).alias(c) for k, c in enumerate(("section", "subject", "measure"), 1)]
    return df.select(*parts, "amount")


def _copies(text: DataFrame) -> DataFrame:
    """Rows beyond the first of equal ones, ids, and rows beyond the first of an id; rows without an id share the missing one.

    Rows are told apart by a digest of 256 bits, and equal ones are counted before the shuffle.
    """
    digest = F.sha2(F.to_json(F.struct(*text.columns)), 256)
    rows = text.select("restaurant_id", digest.alias("_digest")).groupBy("restaurant_id", "_digest").agg(F.count("*").alias("_n"))
    ids = rows.groupBy("restaurant_id").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_copies"))
    zero = F.lit(0)
    row = ids.agg(
        F.coalesce(F.sum("_copies"), zero).alias("counter|exact_duplicate_rows|count"),
        F.count("restaurant_id").alias("counter|unique_restaurant_ids|count"),
        F.coalesce(F.sum(F.col("_n") - 1), zero).alias("counter|duplicate_restaurant_ids|count"),
    )
    return _named(row.unpivot([], row.columns, "cell", "amount"))


def _cells(typed: DataFrame) -> DataFrame:
    """Values that are counted or ranked, each once with its number of rows ``n``."""
    def cell(section: str, subject: Column, content: Column | None = None, number: Column | None = None, where: Column | None = None) -> Column:
        held = F.struct(
            F.lit(section).alias("section"), subject.cast("string").alias("subject"),
            (F.lit(None) if content is None else content).cast("string").alias("content"),
            (F.lit(None) if number is None else number).cast("double").alias("number"),
        )
        return held if where is None else F.when(where, held)

    cost, rating, votes, currency = (F.col(c) for c in ("average_cost_for_two", "aggregate_rating", "votes", "currency"))
    cells = [
        cell("currency", currency),
        cell("country_currency", F.col("country_code").try_cast("int"), currency, where=F.col("country_code").try_cast("int").isNotNull() & currency.isNotNull()),
        *(cell("flag", F.lit(c), F.col(c), where=F.col(c).isNotNull()) for c in SERVICE_FLAGS),
        cell("cost_fence", currency, number=cost, where=cost > 0),
        cell("numeric_fence", F.lit(_FENCED[0]), number=rating, where=rating > 0),
        cell("numeric_fence", F.lit(_FENCED[1]), number=votes, where=votes.isNotNull()),
    ]
    held = typed.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
    return held.groupBy("section", "subject", "content", "number").agg(F.count("*").alias("n"))


def _values(cells: DataFrame) -> DataFrame:
    counted = cells.where("section = 'currency'").select("section", "subject", F.lit("rows").alias("measure"), F.col("n").alias("amount"))
    listed = cells.where("section in ('country_currency', 'flag')").select("section", "subject", F.lit("value").alias("measure"), "content")
    return _lines(counted).unionByName(_lines(listed))


def _fences(cells: DataFrame, leaf_rows: int) -> DataFrame:
    """Fences of each currency's positive costs, and of ratings and votes; a currency without a positive cost has none."""
    keys = ["section", "subject"]
    ranked = cells.where("section in ('cost_fence', 'numeric_fence')").select(*keys, "number", "n")
    lower, upper = quality.fences(F.col("q1"), F.col("q3"))
    fenced = quantiles(ranked, keys, "number", {"q1": 0.25, "q3": 0.75}, leaf_rows, "n").select(*keys, lower.alias("lower"), upper.alias("upper"))
    beyond = (F.col("number") > F.col("upper")) | ((F.col("section") == "numeric_fence") & (F.col("number") < F.col("lower")))
    judged = null_safe_join(ranked, fenced, keys).groupBy(*keys, "lower", "upper").agg(
        F.sum("n").alias("rows"), F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("flagged"),
    )
    subjects = cells.where("section = 'currency'").select(F.lit("cost_fence").alias("section"), "subject")
    fixed = cells.sparkSession.createDataFrame([("numeric_fence", c) for c in _FENCED], "section string, subject string")
    every = null_safe_join(subjects.unionByName(fixed), judged, keys, "left")
    zero = F.lit(0).cast("bigint")
    measures = F.array(
        F.struct(F.lit("rows").alias("measure"), F.coalesce("rows", zero).alias("amount"), F.lit(None).cast("double").alias("number")),
        F.struct(F.lit("flagged_rows").alias("measure"), F.coalesce("flagged", zero).alias("amount"), F.lit(None).cast("double").alias("number")),
        F.struct(F.lit("iqr_lower_fence").alias("measure"), F.lit(None).cast("bigint").alias("amount"), F.col("lower").alias("number")),
        F.struct(F.lit("iqr_upper_fence").alias("measure"), F.lit(None).cast("bigint").alias("amount"), F.col("upper").alias("number")),
    )
    return every.select(*keys, F.explode(measures).alias("m")).select(*keys, "m.*")
