"""Helpers that the operators share.

No operator leaves a setting of the session changed.  Spark bounds Arrow batches by rows and by bytes, so a batch of
very long texts is a short one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions.ordered import cut

__all__ = ["ByPlace", "chunks", "cut", "key_of", "pick", "shared", "small_batches"]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, matched by exact name and the first of equals, whatever else df holds.

    Columns are renamed by position first, so names that clash with one another, or differ in case
    only, cause no ambiguity.
    """
    own = df.columns
    by_place = [f"_{i}" for i in range(len(own))]
    return df.toDF(*by_place).select(*[F.col(by_place[own.index(n)]).alias(n) for n in names])


class ByPlace:
    """A DataFrame whose columns are known by place while whole rows are handled, so that clashing names cause no ambiguity."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_{i}" for i in range(len(self.names))])

    def name(self, column: str) -> str:
        """The name that a column goes by; of equals the first."""
        return f"_{self.names.index(column)}"

    def back(self, df: DataFrame) -> DataFrame:
        """The own columns of df under their first names."""
        return df.select(*self.df.columns).toDF(*self.names)


def key_of(column: Column) -> Column:
    """A text for an id of any type that is equal for equal ids, null among them."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While what is written at once, by cut(), runs: Arrow batches of so many rows.  Then the session has its own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def chunks(batches: Iterable[pd.Series], rows: int = 256) -> Iterator[pd.Series]:
    """The same rows in short pieces, so that what is made of them, which may be larger than they are, goes out piece by piece."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def shared(value) -> Broadcast:
    """A value whose size does not grow with the data, broadcast to the workers."""
    return SparkSession.active().sparkContext.broadcast(value)
