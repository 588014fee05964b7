"""JSON lines, read strictly: a line that is blank, no JSON or no object is an error that names its file and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions.ordered import running
from siltstone.sources.splits import lines


def flaw(raw: Column) -> Column:
    """What is wrong with a line, or null."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return F.when(F.trim(raw) == "", "blank").when(kind.isNull(), "invalid").when(~F.startswith(kind, F.lit("OBJECT")), "not_an_object")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(filename, line, raw) of all lines, numbered from 1 in each file."""
    return running(lines(spark, path), ["filename"], ["record_start"]).select("filename", F.col("number").alias("line"), "raw")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines under a schema; the first flaw met ends the query."""
    own = numbered(spark, path).withColumn("flaw", flaw(F.col("raw")))
    told = F.raise_error(F.concat_ws(" ", F.col("flaw"), F.lit("JSON line at"), F.concat_ws(":", "filename", "line")))
    row = F.from_json(F.when(F.col("flaw").isNull(), F.col("raw")).otherwise(told.cast("string")), schema, {"mode": "FAILFAST"})
    return own.select(row.alias("row")).select("row.*")


def conversations(spark: SparkSession, path: str, source: str | None = None, default: str | None = None) -> DataFrame:
    """(conversation_id, source, messages) of JSON lines, blank ones left out; of one source, if it is named, default standing for a missing one."""
    schema = "conversation_id string, source string, messages array<struct<role:string,content:string>>"
    own = numbered(spark, path).filter(F.trim("raw") != "").withColumn("flaw", flaw(F.col("raw")))
    told = F.raise_error(F.concat_ws(" ", F.col("flaw"), F.lit("JSON line at"), F.concat_ws(":", "filename", "line")))
    row = F.from_json(F.when(F.col("flaw").isNull(), F.col("raw")).otherwise(told.cast("string")), schema, {"mode": "FAILFAST"})
    rows = own.select(row.alias("row")).select("row.*").withColumn("source", F.coalesce("source", F.lit(default)))
    return rows.filter(F.col("source") == source) if source else rows
