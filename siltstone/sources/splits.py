"""Files as byte ranges, and lines by the range that holds their first byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions.ordered import running


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the files in a folder that match; only their listing is read."""
    own = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return own.select("path", F.col("length").alias("size")).filter("size > 0")


def ranges(listing: DataFrame, region: int) -> DataFrame:
    """(path, range_start, range_end): every file in ranges of region bytes, the last one shorter."""
    own = listing.filter("size > 0").withColumn("range_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(region).cast("long"))))
    return own.select("path", "range_start", F.least(F.col("range_start") + region, F.col("size")).alias("range_end"))


def identity(revision: str, item: DataFrame) -> DataFrame:
    """item with ``work_item_id``, a digest of what it stands for."""
    return item.withColumn("work_item_id", F.sha2(F.concat_ws("\x1f", F.lit(revision), "path", "range_start", "range_end").cast("binary"), 256))


def coverage(items: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, size, items, covered, exact): whether a file's ranges, each named once, cover every byte once.

    They do if they are as many as their starts, begin at 0, end at the size, and each begins where another ends.
    """
    sums = identity("", items).groupBy(F.col("path").alias("p")).agg(
        F.count("*").alias("items"), F.countDistinct("work_item_id").alias("ids"), F.sum(F.col("range_end") - F.col("range_start")).alias("covered"), F.min("range_start").alias("first"), F.max("range_end").alias("last")
    )
    ends = items.select(F.col("path").alias("_p"), F.col("range_end").alias("_e")).distinct()
    joined = items.join(ends, (F.col("path") == F.col("_p")) & (F.col("range_start") == F.col("_e"))).groupBy(F.col("path").alias("q")).agg(F.count("*").alias("linked"))
    met = listing.join(sums, F.col("path") == F.col("p"), "left").join(joined, F.col("path") == F.col("q"), "left")
    exact = (F.col("first") == 0) & (F.col("last") == F.col("size")) & (F.col("ids") == F.col("items")) & (F.coalesce("linked", F.lit(0)) == F.col("items") - 1) & (F.col("covered") == F.col("size"))
    return met.select("path", "size", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce(exact, F.lit(False)).alias("exact"))


def shuffled(items: DataFrame, seed: str) -> DataFrame:
    """(id, place) of ranges, ordered by the hash of seed and id."""
    ids = items.select(F.concat_ws(":", "path", "range_start").alias("id"))
    keyed = ids.withColumn("key", F.sha2(F.concat(F.lit(seed.encode() + b"\0"), F.col("id").cast("binary")), 256))
    return running(keyed, [], ["key", "id"]).select("id", (F.col("number") - 1).alias("place"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(filename, record_start, raw): the lines of text files with the offset of their first byte.

    Spark deals a line to the split that holds its first byte.  Lines end in a line feed alone, so a carriage return
    before it counts for the offset and is then left out.  Offsets are running sums of line lengths
    within a file, in file order, by way of the reader's own block offsets.
    """
    own = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"),
        F.monotonically_increasing_id().alias("ord"), (F.octet_length("value") + 1).cast("long").alias("bytes"),
    )
    bare = F.when(F.endswith("raw", F.lit("\r")), F.substr("raw", F.lit(1), F.length("raw") - 1)).otherwise(F.col("raw"))
    return running(own, ["filename"], ["block", "ord"], ["bytes"]).select("filename", F.col("before_bytes").alias("record_start"), bare.alias("raw"))
