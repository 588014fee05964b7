"""Audits: rows that break an invariant, none where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.ordered import running


def differences(manifest: DataFrame, ledger: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, problem): rows that the ledger lacks, has beyond the manifest, or has with another value."""
    right = ledger.select(*[F.col(c).alias(f"_{c}") for c in [*keys, *fields]])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    met = manifest.select(*keys, *fields).join(right, same, "full_outer")
    equal = F.lit(True)
    for f in fields:
        equal &= F.col(f).eqNullSafe(F.col(f"_{f}"))
    problem = F.when(F.col(f"_{keys[0]}").isNull(), "missing").when(F.col(keys[0]).isNull(), "unexpected").when(~equal, "differs")
    return met.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], problem.alias("problem")).filter(F.col("problem").isNotNull())


def tree_digest(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, digest): one digest of a set of lines, whatever their order.

    Lines' digests are put in order and hashed in buckets by their first four hex digits, and the buckets'
    digests are hashed in turn, so a row gathers a 65,536th of a set at a time.
    """
    hashed = lines.select(*by, F.sha2(F.col(line).cast("binary"), 256).alias("h"))
    buckets = hashed.groupBy(*by, F.substring("h", 1, 4).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary"), 256).alias("d"))
    rows = buckets.groupBy(*by).agg(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "d"))).alias("b"))
    return rows.select(*by, F.sha2(F.array_join("b", "\n").cast("binary"), 256).alias("digest"))


def discontinuities(ranges: DataFrame, by: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """ranges with ``problem`` and ``size``: those that begin after the one before ended, a gap, or earlier, an overlap.

    Each range is matched with its successor by their numbers, without a window over a whole group.
    """
    placed = running(ranges, by, order)
    before = placed.select(*[F.col(c).alias(f"_{c}") for c in by], (F.col("number") + 1).alias("_number"), F.col(end).alias("_end"))
    same = F.col("number") == F.col("_number")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    off = F.col(start) - F.col("_end")
    met = placed.join(before, same).filter(off != 0)
    return met.withColumns({"problem": F.when(off > 0, "gap").otherwise("overlap"), "size": F.abs(off)}).select(*ranges.columns, "problem", "size")


def problems(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, problem): a row for each check that holds; one that cannot be told does not."""
    found = F.array_compact(F.array(*[F.when(condition, name) for name, condition in checks.items()]))
    return rows.select(*keys, F.explode(found).alias("problem"))


def drift(own: DataFrame, frozen: DataFrame, counter: str, value: str) -> DataFrame:
    """(counter, value, frozen, equal): counters against those of a frozen manifest; one that either lacks is unequal."""
    right = frozen.select(F.col(counter).alias("_c"), F.col(value).alias("frozen"))
    met = own.select(counter, value).join(right, F.col(counter) == F.col("_c"), "full_outer")
    return met.select(F.coalesce(counter, "_c").alias(counter), value, "frozen", F.col(value).eqNullSafe(F.col("frozen")).alias("equal"))


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, first: str, last: str, bucket: int = 1024) -> DataFrame:
    """rows joined with the range that holds their value; both are dealt to buckets of values, on which they meet by equality.

    A range goes to every bucket that it touches.
    """
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col(last) / bucket))))
    met = rows.withColumn("_bucket", F.floor(F.col(value) / bucket)).join(spread, "_bucket")
    return met.filter(F.col(value).between(F.col(first), F.col(last))).drop("_bucket")
