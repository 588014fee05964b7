"""Texts that hold a probe: equality, or a probe of some length within the text.

No text is compared with every probe.  A probe that stands in a text shares whole words with it, all but its first
and last, so texts and probes meet on a hash of those words, and only what meets is compared.  Which side
is broadcast, if any, is left to its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Inner words by whose hash a probe is looked for.
WORDS = 4


def _hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; words is a column that is there already, as it is read once for each run."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))
    return F.when(F.size(words) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _windows(text: Column, size: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.substr(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, probes: DataFrame, key: str, body: str, probe: str, least: int = 32) -> DataFrame:
    """(key): ids of the texts that equal a probe or hold one of least characters or more.

    Texts and probes are folded, so their words are parted by one blank.  Null texts and probes, and empty probes, hold nothing.
    """
    texts = docs.select(F.col(key).alias("id"), F.col(body).alias("body")).filter(F.col("body").isNotNull())
    own = probes.select(F.col(probe).alias("probe")).filter("probe <> ''").distinct()
    found = [texts.join(own, F.col("body") == F.col("probe"), "left_semi").select("id")]
    words = F.split("probe", " ")
    inner = F.size(words) - 2
    kind = F.when(inner >= WORDS, WORDS).when(inner >= 1, 1).otherwise(0)
    long = own.filter(F.length("probe") >= least).withColumn("kind", kind)
    for k in sorted(r.kind for r in long.select("kind").distinct().collect()):
        mark = F.xxhash64(F.array_join(F.slice(words, 2, k), " ")) if k else F.xxhash64(F.substr("probe", F.lit(1), F.lit(least)))
        sought = long.filter(F.col("kind") == k).select("probe", mark.alias("mark"))
        cut = texts.select("id", F.split("body", " ").alias("words")) if k else texts
        marks = _hashes(F.col("words"), k) if k else _windows(F.col("body"), least)
        met = cut.select("id", F.explode(marks).alias("mark")).join(sought, "mark").select("id", "probe").distinct()
        found.append(met.join(texts, "id").filter(F.contains("body", "probe")).select("id"))
    return reduce(DataFrame.union, found).distinct().withColumnRenamed("id", key)
