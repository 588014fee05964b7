"""Numbers and running sums in a total order, without one task for a whole group.

Rows are range-partitioned by group and order, summed within a partition, and lifted by the totals of
earlier partitions.  The table of lifts has at most as many rows as partitions and groups together.
Feed it ids and counts, never texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names, its lineage ended.

    On one machine a temporary folder will do where none is named; on a cluster executors would each write to
    a folder of their own, so that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str] = ()) -> DataFrame:
    """df with ``number``, from 1 in each group, and ``before_<column>``, the sum of a column over the group's earlier rows.

    What is ranged is read twice, once for the bounds of the ranges, so it is written first: its counts are made once.
    """
    ranged = cut(df).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_part", *by).orderBy(*order)
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    columns = {"number": F.row_number().over(here).cast("long")}
    columns |= {f"before_{c}": F.coalesce(F.sum(c).over(past), F.lit(0)) for c in sums}
    local = cut(ranged.withColumns(columns))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_part", *by).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    lift = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    lifts = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], lift("_n").alias("_ln"), *[lift(f"_s_{c}").alias(f"_l_{c}") for c in sums])
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    lifted = {"number": F.col("number") + F.col("_ln")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"_l_{c}") for c in sums}
    return local.join(lifts, same).withColumns(lifted).select(*df.columns, *lifted)


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """df with ``before``, the largest value among the group's earlier rows; null for the first."""
    ranged = cut(df).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    past = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut(ranged.withColumn("before", F.max(value).over(past)))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = local.groupBy("_part", *by).agg(F.max(value).alias("_top"))
    lifts = tops.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], F.max("_top").over(earlier).alias("_lift"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return local.join(lifts, same).withColumn("before", F.greatest("before", "_lift")).select(*df.columns, "before")
