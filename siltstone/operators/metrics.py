"""Aggregates over scored tokens, paired outcomes, mixtures and ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.ordered import running

LN2 = math.log(2.0)


def scored(logits: Column, label: Column) -> dict[str, Column]:
    """Of an array of logits: loss, rank of the label, top probability, mass of the five best, entropy, whether the best is the label."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(exps, lambda x: x / total)
    own = F.get(logits, label)
    five = F.aggregate(F.slice(F.sort_array(probs, asc=False), 1, 5), F.lit(0.0), lambda a, x: a + x)
    return {
        "loss": F.ln(total) + top - own,
        "true_rank": F.size(F.filter(logits, lambda x: x > own)) + 1,
        "top1_probability": F.array_max(probs),
        "true_probability": F.get(probs, label),
        "top5_mass": five,
        "entropy": F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0)),
        "correct": F.array_position(logits, top) - 1 == label,
    }


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(80.0)))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """(bin, n, confidence, accuracy) for bins of equal width; a confidence of one is in the last."""
    bin_of = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_of.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )


def calibration_error(table: DataFrame) -> DataFrame:
    sums = table.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("gap"))
    return sums.select((F.col("gap") / F.col("n")).alias("ece"))


def mcnemar(wins: Column, losses: Column) -> Column:
    """Exact two-sided p of a paired comparison: min(1, 2 * sum of C(n, i) / 2**n for i up to the smaller count)."""
    n, k = wins + losses, F.least(wins, losses)
    log_term = lambda i: F.aggregate(  # noqa: E731  ln C(n, i)
        F.sequence(F.lit(1), F.greatest(i, F.lit(1)).cast("int")), F.lit(0.0), lambda a, j: a + F.when(j <= i, F.ln((n - j + 1).cast("double")) - F.ln(j.cast("double"))).otherwise(0.0)
    )
    terms = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: F.exp(log_term(i) - n * F.lit(LN2)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def bootstrap(units: DataFrame, unit: str, numerator: str, denominator: str, rounds: int, seed: int) -> DataFrame:
    """(low, high): the nearest-rank 95 % interval of sum(numerator) / sum(denominator) over units drawn again.

    Every round draws as many units as there are, with replacement: the place of a draw is a hash of seed, round
    and draw, modulo their number.  Draws meet the units on that place, so neither side is gathered; what is, in
    the end, is one ratio a round.
    """
    numbered = running(units.select(unit, numerator, denominator), [], [unit]).withColumn("place", F.col("number") - 1)
    size = numbered.agg(F.count("*").alias("m"))
    draws = numbered.select(F.col("place").alias("draw")).crossJoin(F.broadcast(size)).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("round"), F.lit(":"), F.col("draw")).cast("binary"))
    draws = draws.select("round", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.col("m")).alias("place"))
    ratios = draws.join(numbered, "place").groupBy("round").agg((F.sum(numerator) / F.sum(denominator)).alias("ratio"))
    ordered = ratios.agg(F.sort_array(F.collect_list("ratio")).alias("r"))
    place = lambda q: F.get(F.col("r"), F.least(F.bround(F.lit(q) * (F.size("r") - 1)).cast("int"), F.size("r") - 1))
    return ordered.select(place(0.025).alias("low"), place(0.975).alias("high"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the middle value of each group, or the mean of the two, found by their places in a spread order."""
    placed = running(rows.select(by, value), [by], [value])
    sizes = placed.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    middle = placed.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).filter(F.col("number").between(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    return middle.groupBy(by).agg(F.avg(F.col(value).cast("double")).alias("median"))


def shares(rows: DataFrame, by: str, size: str) -> DataFrame:
    """(by, total, share): a group's part of everything."""
    totals = rows.groupBy(by).agg(F.sum(size).alias("total"))
    whole = totals.agg(F.sum("total").alias("whole"))
    return totals.crossJoin(F.broadcast(whole)).select(by, "total", (F.col("total") / F.col("whole")).alias("share"))
