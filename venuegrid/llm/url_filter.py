"""Operator 3: URL rules, and character language models for the URLs that no rule decides; DataFrame functions only.

Two variable-order Markov models with Witten-Bell smoothing are trained on the URLs
that rules accept and reject. A URL's score is the difference of its log
likelihoods per character; the threshold is calibrated on ruled URLs kept out of the
counts. Counts are kept for each five-character piece, which has four characters of
context, and shorter contexts are summed from them; the log ratio is worked out once
for each distinct piece and then joined to the URLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.llm import columns as c
from venuegrid.llm.scratch import Scratch

#: The rules that the queries use.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER, ALPHABET, HELD_OUT, BINS = 4, 256, 5, 100
_START, _END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, c.lowered(host)).otherwise(""), F.when(has, path).otherwise("")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as its place in ``rules``."""
    def fits(rule: str) -> Column:
        domain, slash, start = rule.partition("/")
        return ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)

    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    return F.coalesce(*[F.when(fits(rules[k][1]), F.lit(k)) for k in ranked], F.lit(None).cast("int"))


def pieces(body: Column) -> Column:
    """For each character and the end, the four characters before it and itself."""
    padded = F.concat(F.lit(_START * ORDER), body, F.lit(_END))
    return c.let(F.split(padded, ""), lambda chars: F.transform(
        F.sequence(F.lit(1), F.length(body) + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(ORDER + 1)), ""),
    ))


def _log_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(rejected) - log P(accepted) of the last character of each piece."""
    p = {k: F.lit(1.0 / ALPHABET) for k in "ar"}
    rows = grams
    for k in range(ORDER + 1):
        tail, context = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        own = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        seen = own.groupBy(F.substring("tail", 1, k).alias("context")).agg(
            F.sum("a").alias("n_a"), F.sum("r").alias("n_r"),
            F.sum((F.col("a") > 0).cast("long")).alias("t_a"), F.sum((F.col("r") > 0).cast("long")).alias("t_r"),
        )
        rows = rows.withColumns({"tail": tail, "context": context}).join(own, "tail", "left").join(seen, "context", "left")
        for x in "ar":
            n, t, met = (F.coalesce(col, F.lit(0)) for col in (f"n_{x}", f"t_{x}", x))
            p[x] = F.when(n > 0, (met + t * p[x]) / (n + t)).otherwise(p[x])
        rows = rows.select("gram", p["a"].alias("p_a"), p["r"].alias("p_r"))
        p = {x: F.col(f"p_{x}") for x in "ar"}
    return rows.select("gram", (F.log("p_r") - F.log("p_a")).alias("ratio"))


def _scores(scratch: Scratch, bodies: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, bin): hundredths of the score of each body, rounded down."""
    dealt = bodies.select("key", F.explode(pieces(F.col("body"))).alias("gram"))
    ratios = scratch.settle(_log_ratios(dealt.select("gram").distinct(), counts), "ratios")
    sums = dealt.join(ratios, "gram").groupBy("key").agg(F.avg("ratio").alias("score"))
    return sums.select("key", F.floor(F.round(F.col("score"), 9) * BINS).alias("bin"))


def calibrated(lines: list[tuple[int, str, int]]) -> int:
    """The bin from which URLs are rejected: best sum of both classes' hit rates; ties go to the one nearest 0."""
    totals = {v: sum(n for _, w, n in lines if w == v) for v in ("allow", "block")}
    if not all(totals.values()):
        return 0
    options = sorted({b for b, _, _ in lines} | {max(b for b, _, _ in lines) + 1, 0}, key=lambda b: (abs(b), b))

    def hits(t: int) -> float:
        right = {"block": sum(n for b, v, n in lines if v == "block" and b >= t), "allow": sum(n for b, v, n in lines if v == "allow" and b < t)}
        return round(right["block"] / totals["block"] + right["allow"] / totals["allow"], 12)

    return max(options, key=hits)


def _clipped(score_bin: str) -> Column:
    """Scores beyond 20 in size count as 20, where the threshold is set and where it is used."""
    return F.greatest(F.lit(-20 * BINS), F.least(F.lit(20 * BINS), score_bin))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, url: str = "url", into: str = "verdict") -> DataFrame:
    """Every row of ``pages`` with the struct ``into``: host, path, rule, verdict, score_bin (null where a rule decides).

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest wins. Other URLs get the models' verdict on host and path. A missing URL
    or one without ``://`` has an empty host and path, fits no rule and is judged as
    an empty text. Equal URLs get equal verdicts; each distinct host and path counts
    once in training. Without ruled URLs of both classes the threshold is 0, and a
    model without URLs is uniform. A column named ``into`` is replaced; others may
    have any name. URLs may be of any length.
    """
    plain = pages.select(*[pages[f"`{n}`"] for n in pages.columns if n.lower() != into.lower()])
    host, path = host_and_path(plain[f"`{url}`"].cast("string"))
    # the given columns travel as one, so that their names meet no others
    parts = plain.select(c.packed(plain), host.alias("__host"), path.alias("__path"))
    parts = parts.withColumn("__rule", longest_rule(F.col("__host"), F.col("__path"), rules))
    verdict = reduce(lambda other, k: F.when(F.col("__rule") == k, rules[k][0]).otherwise(other), range(len(rules)), F.lit(None).cast("string"))
    parts = parts.withColumn("__verdict", verdict).withColumn("__body", F.concat("__host", "__path")).withColumn("__key", F.xxhash64("__body"))

    with Scratch(pages.sparkSession) as scratch:
        bodies = parts.groupBy(F.col("__key").alias("key")).agg(F.first("__body").alias("body"), F.first("__verdict").alias("verdict"))
        bodies = scratch.settle(bodies.withColumn("held_out", F.pmod("key", F.lit(HELD_OUT)) == 0), "urls")
        learned = bodies.where("verdict is not null and not held_out").select("verdict", F.explode(pieces(F.col("body"))).alias("gram"))
        counts = learned.groupBy("gram").agg(
            F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("r"),
        )
        counts = scratch.settle(counts, "counts")
        scores = scratch.keep(_scores(scratch, bodies.where("verdict is null or held_out"), counts), "scores")
        tuning = scores.join(bodies.where("verdict is not null").select("key", "verdict"), "key").groupBy("bin", "verdict").count()
        clipped = tuning.groupBy(_clipped("bin").alias("bin"), "verdict").agg(F.sum("count").alias("n"))
        tuned = clipped.collect()  # bins of a fixed range
    threshold = calibrated([(r.bin, r.verdict, r.n) for r in tuned])

    open_ = scores.select(F.col("key").alias("__k"), F.col("bin").alias("__bin"))
    joined = parts.join(open_, (parts["__key"] == open_["__k"]) & parts["__verdict"].isNull(), "left")
    own = F.when(_clipped("__bin") >= threshold, "block").otherwise("allow")
    rule = reduce(lambda other, k: F.when(F.col("__rule") == k, rules[k][1]).otherwise(other), range(len(rules)), F.lit(None).cast("string"))
    return c.unpacked(joined, F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce("__verdict", own).alias("verdict"), F.col("__bin").alias("score_bin"),
    ), plain.columns, into)
