"""Sequences in shards of unsigned 16-bit tokens, with a manifest, and back again.

A shard holds a fixed number of sequences, so what one task gathers is bounded by the shard size.  The
table of payloads is written by Spark's own committer; readers verify length and checksum before use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.functions.scalars import from_little_endian, little_endian


def build(sequences: DataFrame, per_block: int, blocks: int, seq: str = "seq", tokens: str = "tokens") -> DataFrame:
    """(shard, payload, checksum, byte_size, sequences, first_block, last_block) of sequences numbered from 0."""
    return _joined(sequences.select(F.col(seq).alias("seq"), F.hex(little_endian(F.col(tokens))).alias("raw")), per_block, blocks)


def _joined(parts: DataFrame, per_block: int, blocks: int) -> DataFrame:
    """Shards of sequences (seq, raw), raw being their bytes in hex."""
    own = parts.withColumn("shard", F.floor(F.col("seq") / (per_block * blocks)))
    shards = own.groupBy("shard").agg(
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]), "")).alias("payload"),
        F.count("*").alias("sequences"), F.floor(F.min("seq") / per_block).alias("first_block"), F.floor(F.max("seq") / per_block).alias("last_block"),
    )
    return shards.select("shard", "payload", F.sha2("payload", 256).alias("checksum"), F.octet_length("payload").cast("long").alias("byte_size"), "sequences", "first_block", "last_block")


def manifest(shards: DataFrame) -> DataFrame:
    """What is known of shards without their payload."""
    return shards.drop("payload")


def decode(shards: DataFrame, sequence_tokens: int, per_block: int) -> DataFrame:
    """(seq, tokens) of shards whose sequences have that many tokens each."""
    step = sequence_tokens * 2
    parts = F.sequence(F.lit(0), (F.col("byte_size") / step).cast("int") - 1)
    own = shards.filter("byte_size > 0").select("first_block", "payload", F.explode(parts).alias("i"))
    own = own.select((F.col("first_block") * per_block + F.col("i")).alias("seq"), F.substr("payload", F.col("i") * step + 1, F.lit(step)).alias("part"))
    return own.select("seq", from_little_endian(F.col("part")).alias("tokens"))


def reblocked(shards: DataFrame, sequence_tokens: int, per_block: int, new_per_block: int, new_blocks: int) -> DataFrame:
    """Shards of the same sequences in blocks of another size; their bytes are cut apart and joined, never decoded."""
    step, own = sequence_tokens * 2, shards.filter("byte_size > 0")
    places = F.sequence(F.lit(0), (F.col("byte_size") / step).cast("int") - 1)
    parts = own.select((F.col("first_block") * per_block).alias("_from"), "payload", F.explode(places).alias("i"))
    parts = parts.select((F.col("_from") + F.col("i")).alias("seq"), F.hex(F.substr("payload", F.col("i") * step + 1, F.lit(step))).alias("raw"))
    return _joined(parts, new_per_block, new_blocks)


def problems(shards: DataFrame, sequence_tokens: int, vocabulary: int = 50_257) -> DataFrame:
    """(shard, problem): shards whose size, checksum or tokens are wrong."""
    tokens = from_little_endian(F.col("payload"))
    found = F.array_compact(F.array(
        F.when((F.octet_length("payload") != F.col("byte_size")) | (F.col("byte_size") % (2 * sequence_tokens) != 0), "size"),
        F.when(F.sha2("payload", 256) != F.col("checksum"), "checksum"),
        F.when(F.exists(tokens, lambda t: t >= vocabulary), "token_range"),
    ))
    return shards.select("shard", F.explode(found).alias("problem"))


def write_jsonl(rows: DataFrame, path: str, order: str) -> None:
    """Rows as JSON lines, in order within and across the files."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").json(path)


def write_by(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rows as Parquet in a folder for each value, such as split and source."""
    rows.write.mode("errorifexists").partitionBy(*by).parquet(path)
