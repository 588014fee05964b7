"""Publishing a stream batch by batch so that a reader sees every block once, whatever fails.

A micro-batch is written to a folder named by its number, which a repeated attempt overwrites, and only then added to
the frontier, a list of ready batches that a reader trusts.  What a failed attempt left behind is never
listed, so it is never seen.  Spark's checkpoint keeps the source's offsets, and replays a batch with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def ready(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, first, last) of the batches that are ready, each once; empty before the first."""
    try:
        own = spark.read.schema("batch long, rows long, first long, last long").json(f"{folder}/ready/*")
    except Exception as missing:  # the folder comes with the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        own = spark.createDataFrame([], "batch long, rows long, first long, last long")
    return own.distinct()


def publish(stream: DataFrame, folder: str, checkpoint: str, order: str) -> StreamingQuery:
    """Write all that is there, rows of each batch in order of a column, and stop: what comes later is for the next call."""

    def write(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{folder}/blocks/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{folder}/blocks/batch={number}")
        line = stored.agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last")).filter("rows > 0")
        line.select(F.lit(number).cast("long").alias("batch"), "rows", "first", "last").coalesce(1).write.mode("overwrite").json(f"{folder}/ready/batch_{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches that are ready."""
    return spark.read.parquet(f"{folder}/blocks").join(ready(spark, folder).select("batch"), "batch").drop("batch")


def faults(spark: SparkSession, folder: str, before: DataFrame | None = None) -> DataFrame:
    """(batch, problem): where the frontier has holes, where a batch does not hold what it says, and what an earlier frontier had otherwise."""
    own = ready(spark, folder)
    stored = spark.read.parquet(f"{folder}/blocks").groupBy(F.col("batch").cast("long").alias("b")).agg(F.count("*").alias("stored"))
    off = own.join(stored, F.col("batch") == F.col("b"), "left").filter(~F.col("stored").eqNullSafe(F.col("rows"))).select("batch", F.lit("rows").alias("problem"))
    if before is None:
        return off
    was = before.select(F.col("batch").alias("p"), F.col("rows").alias("had"))
    changed = was.join(own, F.col("p") == F.col("batch"), "left").filter(F.col("rows").isNull() | (F.col("rows") != F.col("had")))
    return off.unionByName(changed.select(F.col("p").alias("batch"), F.lit("changed").alias("problem")))
