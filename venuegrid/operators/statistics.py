"""Rank correlation and group tests, computed from distributed counts.

Rows are first counted per distinct combination of values; ranks come from those counts.
Only the finished test lines, one per test, pass through Python for a p-value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.distributions import chi2_p_value, t_p_value
from venuegrid.functions.means import mean
from venuegrid.functions.ranks import LEAF_ROWS, value_ranks
from venuegrid.operators.market import RATED
from venuegrid.session import settle

ALL_CURRENCIES = "All currencies"
SPEARMAN = "Spearman rank correlation"
WELCH = "Welch independent t-test"
KRUSKAL = "Kruskal-Wallis test"
# The variables of the three correlation families.
FAMILIES = [
    ("votes", "aggregate_rating"),
    ("average_cost_for_two", "aggregate_rating"),
    ("average_cost_for_two", "votes"),
]
_KEYS = ["family", "currency"]


def _values(df: DataFrame) -> DataFrame:
    """What the families compare, each combination once with its number of rows ``w``: a line for a listing, not one for each family."""
    cost = F.col("average_cost_for_two").cast("double")
    priced = F.coalesce((cost > 0) & F.col("currency").isNotNull(), F.lit(False))
    rated = F.coalesce(F.col(RATED), F.lit(False))
    held = {
        "rated": rated, "currency": F.when(priced, F.col("currency")), "cost": F.when(priced, cost),
        "rating": F.when(rated, F.col("aggregate_rating").cast("double")), "votes": F.col("votes").cast("double"),
    }
    return df.where(priced | rated).groupBy(*[c.alias(name) for name, c in held.items()]).agg(F.count("*").alias("w"))


def _pairs(values: DataFrame) -> DataFrame:
    """The value pairs of all three families with their rows; a pair may have several lines."""
    votes, rating, cost, rated = (F.col(c) for c in ("votes", "rating", "cost", "rated"))
    priced = cost.isNotNull()

    def pair(keep: Column, family: int, currency: Column, x: Column, y: Column) -> Column:
        return F.when(keep, F.struct(
            F.lit(family).alias("family"), currency.alias("currency"), x.alias("x"), y.alias("y"), F.col("w")
        ))

    lines = F.array_compact(F.array(
        pair(rated, 0, F.lit(ALL_CURRENCIES), votes, rating),
        pair(priced & rated, 1, F.col("currency"), cost, rating),
        pair(priced, 2, F.col("currency"), cost, votes),
    ))
    return values.select(F.explode(lines).alias("line")).select("line.*")


def rank_correlations(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Spearman's rho of votes and rating overall, of cost and rating, and of cost and votes per currency."""
    pairs = _pairs(settle(_values(df), "values"))
    both = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())

    # Twice the distance of the average rank from the middle rank: an integer.
    centred = (2 * F.col("below") + F.col("equal") - F.col("total")).cast("double")
    x_ranks = value_ranks(both, _KEYS, "x", "w", leaf_rows).select(*_KEYS, "x", centred.alias("dx"))
    y_ranks = value_ranks(both, _KEYS, "y", "w", leaf_rows).select(*_KEYS, "y", centred.alias("dy"))
    ranked = both.join(x_ranks, [*_KEYS, "x"]).join(y_ranks, [*_KEYS, "y"])
    w, dx, dy = F.col("w"), F.col("dx"), F.col("dy")
    rho = F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy)))
    # Rounding may push |rho| past 1; a constant column leaves it missing.
    limited = F.when(rho > 1, 1.0).when(rho < -1, -1.0).otherwise(rho)
    found = ranked.groupBy(*_KEYS).agg(limited.alias("statistic"))

    usable = F.col("x").isNotNull() & F.col("y").isNotNull()
    size = F.coalesce(F.sum(F.when(usable, w)), F.lit(0)).alias("n")
    overall = pairs.where("family = 0").agg(size).select(
        F.lit(0).alias("family"), F.lit(ALL_CURRENCIES).alias("currency"), "n"
    )
    sizes = pairs.where("family > 0").groupBy(*_KEYS).agg(size).unionByName(overall)
    names = [F.array(*[F.lit(f[i]) for f in FAMILIES]) for i in (0, 1)]
    return sizes.join(found, _KEYS, "left").select(
        "currency", F.get(names[0], "family").alias("variable_x"), F.get(names[1], "family").alias("variable_y"),
        F.lit(SPEARMAN).alias("test"), "n", F.when(F.col("n") > 1, F.col("statistic")).alias("statistic"),
    )


def spearman(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``rank_correlations`` with two-sided p-values."""
    lines = rank_correlations(df, leaf_rows)
    rho, freedom = F.col("statistic"), F.col("n") - 2
    perfect = F.abs(rho) >= 1
    t = rho * F.sqrt(F.try_divide(freedom, (1 + rho) * (1 - rho)))
    t = F.when(perfect, F.lit(float("inf"))).otherwise(t)
    return lines.withColumn("p_value", t_p_value(t, freedom.cast("double")))


def welch_statistics(
    df: DataFrame, flags: Sequence[str] = ("has_online_delivery", "has_table_booking")
) -> DataFrame:
    """Per flag: sizes, means, Welch's t and its degrees of freedom; one scan for all flags."""
    r = F.col("aggregate_rating")

    def sample(flag: str) -> Column:
        yes, no = F.col(flag) == "Yes", F.col(flag) == "No"
        return F.struct(
            F.lit(flag).alias("variable"),
            F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"),
            mean(r, yes).alias("mean_yes"), mean(r, no).alias("mean_no"),
            F.var_samp(F.when(yes, r)).alias("var_yes"), F.var_samp(F.when(no, r)).alias("var_no"),
        )

    samples = df.where(RATED).agg(*[sample(f).alias(f) for f in flags])
    lines = samples.select(F.explode(F.array(*flags)).alias("s")).select("s.*")
    n1, n2 = F.col("n_yes"), F.col("n_no")
    e1, e2 = F.try_divide(F.col("var_yes"), n1), F.try_divide(F.col("var_no"), n2)
    enough = (n1 >= 2) & (n2 >= 2)
    t = F.try_divide(F.col("mean_yes") - F.col("mean_no"), F.sqrt(e1 + e2))
    freedom = F.try_divide(
        (e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1)
    )
    return lines.select(
        "variable", F.lit(WELCH).alias("test"), "n_yes", "n_no", "mean_yes", "mean_no",
        F.when(enough, t).alias("statistic"), F.when(enough, freedom).alias("freedom"),
    )


def welch_t(df: DataFrame, flags: Sequence[str] = ("has_online_delivery", "has_table_booking")) -> DataFrame:
    lines = welch_statistics(df, flags)
    return lines.withColumn("p_value", t_p_value("statistic", "freedom")).drop("freedom")


def kruskal_statistics(df: DataFrame, group: str = "price_range", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Tie-corrected H of ratings over groups with more than one rated row; no row below two groups."""
    counts = df.where(F.col(RATED) & F.col(group).isNotNull()).groupBy(group, "aggregate_rating").agg(
        F.count("*").alias("w")
    )
    counts = settle(counts, "histogram")
    sizes = counts.groupBy(group).agg(F.sum("w").alias("size")).where("size > 1")
    counts = counts.join(sizes, group)
    ranks = settle(value_ranks(counts, [], "aggregate_rating", "w", leaf_rows), "ranks")
    mid = F.col("below") + (F.col("equal") + 1) / 2
    sums = counts.join(ranks, "aggregate_rating").groupBy(group, "size").agg(F.sum(F.col("w") * mid).alias("r"))
    n = F.col("n").cast("double")
    t = F.col("equal").cast("double")
    ties = ranks.agg(F.coalesce(F.sum(t * t * t - t), F.lit(0.0))).scalar()
    raw = F.lit(12.0) * F.col("spread") / (n * (n + 1)) - 3 * (n + 1)
    whole = sums.agg(
        F.sum("size").alias("n"), F.count("*").alias("groups"),
        F.sum(F.col("r") * F.col("r") / F.col("size")).alias("spread"),
    ).where("groups >= 2").withColumn("ties", ties)
    return whole.select(
        F.lit(group).alias("variable"), F.lit(KRUSKAL).alias("test"), F.col("n").alias("n_yes"),
        F.try_divide(raw, 1 - F.col("ties") / (n * n * n - n)).alias("statistic"),
        (F.col("groups") - 1).alias("freedom"),
    )


def kruskal(df: DataFrame, group: str = "price_range", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    lines = kruskal_statistics(df, group, leaf_rows)
    p = chi2_p_value("statistic", F.col("freedom").cast("double"))
    return lines.withColumn("p_value", p).drop("freedom")


def group_comparisons(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Welch lines of both services and the Kruskal-Wallis line of the price bands."""
    return welch_t(df).unionByName(kruskal(df, leaf_rows=leaf_rows), allowMissingColumns=True)


def statistical_report(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """All test lines in one table, smallest p-value first."""
    correlations = spearman(df, leaf_rows)
    comparisons = group_comparisons(df, leaf_rows)
    return correlations.unionByName(comparisons, allowMissingColumns=True).orderBy(
        F.asc_nulls_last("p_value"), "test", "variable", "currency", "variable_y"
    )
