"""Deterministic choices: first-wins, hash orders, hold-outs, quotas, budgets, top-k."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions.ordered import running


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest order of each key; one aggregation, partial before the shuffle, so that no key's rows meet in one task."""
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def new_only(candidates: DataFrame, base: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates whose key the base lacks, the first of each key."""
    return first_wins(candidates.join(base.select(key).distinct(), key, "left_anti"), key, order)


def hold_out(rows: DataFrame, group: list[str], key: str, fraction: float) -> DataFrame:
    """rows with ``split``: by hash order in each group the first h validation, the next h test, the rest train; h = max(1, half-even(n * fraction))."""
    placed = running(rows, group, [key])
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    h = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("long"))
    split = F.when(F.col("number") <= h, "validation").when(F.col("number") <= 2 * h, "test").otherwise("train")
    return placed.join(sizes, group).withColumn("split", split).drop("number", "_n")


def quota(rows: DataFrame, by: list[str], order: list[str], size: str, least_rows: int, least_size: int) -> DataFrame:
    """Rows in order while the group has fewer than least_rows rows or less than least_size."""
    placed = running(rows, by, order, [size])
    return placed.filter((F.col("number") <= least_rows) | (F.col(f"before_{size}") < least_size)).drop("number", f"before_{size}")


def budget(rows: DataFrame, order: list[str], size: str, target: int, most: int) -> DataFrame:
    """Whole rows in order until the target is reached, none that would pass most; ``reason`` says what ended it."""
    placed = running(rows, [], order, [size]).withColumn("total", F.col(f"before_{size}") + F.col(size))
    stop = placed.filter((F.col("total") > most) & (F.col(f"before_{size}") < target)).agg(F.min("number").alias("_stop"))
    kept = placed.join(F.broadcast(stop)).filter((F.col(f"before_{size}") < target) & (F.col("_stop").isNull() | (F.col("number") < F.col("_stop"))))
    return kept.drop("number", f"before_{size}", "_stop")


def smallest(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, ``place`` from 1; each partition keeps k rows of a group before they meet."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def mixed_order(rows: DataFrame, source: str, order: list[str], size: str, shares: dict[str, int]) -> DataFrame:
    """rows of the sources in shares, with ``sort_key``: what the source had taken before, over its share, as a whole number over a common denominator."""
    whole = math.lcm(*shares.values())
    weight = F.create_map(*[F.lit(x) for name, share in shares.items() for x in (name, whole // share)])[F.col(source)]
    placed = running(rows.filter(F.col(source).isin(*shares)), [source], order, [size])
    return placed.withColumn("sort_key", F.col(f"before_{size}").cast("decimal(20,0)") * weight.cast("decimal(18,0)")).drop("number", f"before_{size}")


def drop_oldest_pairs(turns: DataFrame, conversation: str, turn: str, size: str, most: int) -> DataFrame:
    """(conversation, dropped): the fewest oldest pairs of turns to drop until what is left fits; null where none does.

    turns holds the turns of each conversation without its system turn, numbered from 0.
    """
    later = Window.partitionBy(conversation).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    left = turns.withColumn("left", F.sum(size).over(later))
    return left.filter(F.col(turn) % 2 == 0).groupBy(conversation).agg(F.min(F.when(F.col("left") <= most, (F.col(turn) / 2).cast("long"))).alias("dropped"))


def allocated(strata: DataFrame, stratum: str, have: str, want: Column) -> DataFrame:
    """strata, a row each, with ``taken``: even shares of want, and what some cannot give taken from the others, in their order."""
    everyone = Window.partitionBy()
    own = strata.withColumn("_want", want.cast("long"))
    own = own.withColumn("_share", F.floor(F.col("_want") / F.count("*").over(everyone)))
    own = own.withColumns({"_more": F.greatest(F.col(have) - F.col("_share"), F.lit(0)), "_lack": F.greatest(F.col("_share") - F.col(have), F.lit(0))})
    earlier = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_lack").over(everyone) - F.coalesce(F.sum("_more").over(earlier), F.lit(0))
    taken = F.least(F.col(have), F.col("_share")) + F.greatest(F.lit(0), F.least(F.col("_more"), left))
    return own.withColumn("taken", taken).drop("_want", "_share", "_more", "_lack")


def minimal_prefix(count: int, target: int, measure: Callable[[int, int], dict[int, int]], look_back: int = 256) -> int | None:
    """The smallest prefix whose measure reaches the target: by halving, then among the look_back before it, as the measure need not rise.

    measure(first, last) tells the measures of all prefixes from first to last at once; None if the whole does not reach the target.
    """
    if measure(count, count)[count] < target:
        return None
    low, high = 0, count
    while low < high:
        middle = (low + high) // 2
        if measure(middle, middle)[middle] >= target:
            high = middle
        else:
            low = middle + 1
    near = measure(max(0, low - look_back), low)
    return min((k for k, m in near.items() if m >= target), default=low)


def projected(rows: DataFrame, place: str, group: list[str], key: str, size: str, fraction: float, first: int, last: int) -> dict[int, int]:
    """What remains for training of each prefix, from first to last, of rows numbered from 1, after the hold-out of every group.

    Rows of place 0 are in every prefix.  A prefix's hold-out is that of hold_out(); what comes back is a number for each prefix.
    """
    own = rows.filter(F.col(place) <= last).withColumn("_prefix", F.explode(F.sequence(F.greatest(F.lit(first), F.col(place).cast("int")), F.lit(last))))
    train = hold_out(own.select("_prefix", *group, key, size), ["_prefix", *group], key, fraction).filter("split = 'train'")
    found = {r["_prefix"]: r["n"] for r in train.groupBy("_prefix").agg(F.sum(size).alias("n")).collect()}
    return {k: found.get(k) or 0 for k in range(first, last + 1)}
