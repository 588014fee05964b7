"""Sources by name: each a function from session and folder to rows, with a priority that orders sources among one another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Places that a source has below the next one's.
WIDTH = 10**9


@dataclass(frozen=True)
class Adapter:
    """How a source is read: rows with at least id and text, id a number."""

    priority: int
    rows: Callable[[SparkSession, str], DataFrame]


class Adapters:
    """Sources that can be named; a name and a priority are each given once."""

    def __init__(self) -> None:
        self.known: dict[str, Adapter] = {}

    def add(self, name: str, priority: int, rows: Callable[[SparkSession, str], DataFrame]) -> None:
        if name in self.known or priority in {a.priority for a in self.known.values()}:
            raise ValueError(f"source {name!r} or its priority {priority} is taken")
        self.known[name] = Adapter(priority, rows)

    def read(self, spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
        """(source, priority, id, text) of the named sources, or of all; a name that is not known is an error."""
        missing = [n for n in names or () if n not in self.known]
        if missing:
            raise ValueError(f"unknown sources {missing}")
        chosen = sorted(names or self.known, key=lambda n: self.known[n].priority)
        parts = [self.known[n].rows(spark, folder).select(F.lit(n).alias("source"), F.lit(self.known[n].priority).alias("priority"), F.col("id").cast("long").alias("id"), "text") for n in chosen]
        return reduce(DataFrame.unionByName, parts)
