"""Blocks of tokenised records as framed bytes, with an index, and back again.

A frame is a prefix of four numbers, a header of canonical JSON, the tokens as unsigned 16-bit numbers and the
target masks as bytes.  A block holds whole records and is bounded by its targets, so one row holds one block.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.ordered import running
from siltstone.operators import batching

#: Mark, and sizes of header, tokens and masks.
PREFIX = struct.Struct("<4sIII")
MARK = b"SFRM"
VERSION = 1
RECORD = "record_id string, source string, tokens array<int>, mask array<boolean>"


def encode_block(block: int, split: str, records: list[dict]) -> bytes:
    """Records of record_id, source, tokens and mask, which is one shorter than tokens."""
    targets = [int(sum(r["mask"])) for r in records]
    header = {
        "schema_version": VERSION, "block_id": int(block), "split": split, "record_ids": [r["record_id"] for r in records], "sources": [r["source"] for r in records],
        "lengths": [len(r["tokens"]) for r in records], "target_counts": targets, "target_token_count": sum(targets), "serialized_token_count": sum(len(r["tokens"]) for r in records),
    }
    head = json.dumps(header, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    tokens = b"".join(np.asarray(r["tokens"], dtype="<u2").tobytes() for r in records)
    masks = b"".join(np.asarray(r["mask"], dtype=np.uint8).tobytes() for r in records)
    return PREFIX.pack(MARK, len(head), len(tokens), len(masks)) + head + tokens + masks


def decode_block(frame: bytes) -> tuple[dict, list[dict]]:
    """(header, records); ValueError says what is wrong with a frame."""
    if len(frame) < PREFIX.size:
        raise ValueError("truncated")
    mark, head, tokens, masks = PREFIX.unpack_from(frame)
    if mark != MARK:
        raise ValueError("mark")
    if len(frame) != PREFIX.size + head + tokens + masks or tokens % 2:
        raise ValueError("size")
    try:
        header = json.loads(frame[PREFIX.size : PREFIX.size + head])
        lengths, counts = header["lengths"], header["target_counts"]
        named = list(zip(header["record_ids"], header["sources"], lengths, counts, strict=True))
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("header") from error
    if header.get("schema_version") != VERSION:
        raise ValueError("version")
    if sum(lengths) * 2 != tokens or sum(n - 1 for n in lengths) != masks or min(lengths, default=2) < 2:
        raise ValueError("lengths")
    body = np.frombuffer(frame, "<u2", tokens // 2, PREFIX.size + head)
    flags = np.frombuffer(frame, np.uint8, masks, PREFIX.size + head + tokens)
    if masks and flags.max() > 1:
        raise ValueError("mask")
    records, at, flag_at = [], 0, 0
    for name, source, length, count in named:
        mask = flags[flag_at : flag_at + length - 1]
        if int(mask.sum()) != count:
            raise ValueError("target_counts")
        records.append({"record_id": name, "source": source, "tokens": body[at : at + length].astype(np.int32), "mask": mask.astype(bool)})
        at, flag_at = at + length, flag_at + length - 1
    if sum(counts) != header["target_token_count"]:
        raise ValueError("target_token_count")
    return header, records


def encoded(records: DataFrame, number: str, split: str = "train") -> DataFrame:
    """records (number, record_id, source, tokens, mask) with ``frame``: each by itself as a block of that number."""

    @F.pandas_udf("binary")
    def framed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([encode_block(n, split, [{"record_id": i, "source": s, "tokens": t, "mask": m}]) for n, i, s, t, m in zip(*rows)], dtype=object)

    return records.withColumn("frame", framed(number, "record_id", "source", "tokens", "mask"))


def build(records: DataFrame, order: str, most_targets: int, shard_bytes: int, split: str = "train") -> DataFrame:
    """(shard, offset, block, frame, byte_size, checksum, records, targets, serialized, cumulative): records (order, record_id, source, tokens, mask)
    in blocks of at most most_targets, blocks in shards of about shard_bytes.

    Blocks depend on one another, and so do shards; both are folds over numbers alone.
    """
    sized = records.withColumn("_t", F.size(F.filter("mask", lambda m: m)))
    dealt = batching.next_fit(sized.select(order, "_t").withColumn("_g", F.lit(0)), "_g", [order], {"_t": most_targets}).select(F.col(order).alias("_o"), F.col("batch").alias("block"))
    one = F.struct(order, "record_id", "source", "tokens", "mask")
    blocks = records.join(dealt, F.col(order) == F.col("_o")).groupBy("block").agg(F.sort_array(F.collect_list(one)).alias("own"))

    @F.pandas_udf("binary")
    def framed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for numbers, groups in batches:
            yield pd.Series([encode_block(n, split, list(g)) for n, g in zip(numbers, groups)], dtype=object)

    frames = blocks.select("block", framed("block", "own").alias("frame"), F.size("own").alias("records"), F.flatten("own.mask").alias("_m"), F.flatten("own.tokens").alias("_x"))
    frames = frames.select(
        "block", "frame", F.octet_length("frame").cast("long").alias("byte_size"), F.sha2("frame", 256).alias("checksum"), "records",
        F.size(F.filter("_m", lambda m: m)).cast("long").alias("targets"), F.size("_x").cast("long").alias("serialized"),
    )
    shards = batching.next_fit(frames.select("block", "byte_size").withColumn("_g", F.lit(0)), "_g", ["block"], {"byte_size": shard_bytes})
    places = running(shards.select(F.col("block").alias("_b"), F.col("batch").alias("shard"), "byte_size"), ["shard"], ["_b"], ["byte_size"]).select("_b", "shard", F.col("before_byte_size").alias("offset"))
    totals = running(frames.select(F.col("block").alias("_c"), "targets"), [], ["_c"], ["targets"]).select("_c", (F.col("before_targets") + F.col("targets")).alias("cumulative"))
    met = frames.join(places, F.col("block") == F.col("_b")).join(totals, F.col("block") == F.col("_c"))
    return met.select("shard", "offset", "block", "frame", "byte_size", "checksum", "records", "targets", "serialized", "cumulative")


def read(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """(block, record_id, source, tokens, mask) of all records of good frames."""

    @F.pandas_udf(f"array<struct<{RECORD.replace(' string', ':string').replace(' array', ':array')}>>")
    def taken(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([decode_block(bytes(x))[1] for x in rows], dtype=object)

    return frames.select("block", F.explode(taken(F.col(frame))).alias("r")).select("block", "r.*")


def flaw(frame: Column) -> Column:
    """What is wrong with a frame, or null."""

    @F.pandas_udf("string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x) -> str | None:
            try:
                decode_block(bytes(x))
            except ValueError as error:
                return str(error)

        for rows in batches:
            yield pd.Series([one(x) for x in rows], dtype=object)

    return judged(frame)


def faults(frames: DataFrame) -> DataFrame:
    """(block, problem): frames whose bytes, checksum, place or running counter disagree with their index."""
    own = running(frames, ["shard"], ["block"], ["byte_size"]).withColumn("flaw", flaw(F.col("frame")))
    totals = running(frames.select(F.col("block").alias("_c"), "targets"), [], ["_c"], ["targets"])
    met = own.join(totals.select("_c", F.col("number").alias("_n"), (F.col("before_targets") + F.col("targets")).alias("_t")), F.col("block") == F.col("_c"))
    found = F.array_compact(F.array(
        F.col("flaw"), F.when(F.octet_length("frame") != F.col("byte_size"), "byte_size"), F.when(F.sha2("frame", 256) != F.col("checksum"), "checksum"),
        F.when(F.col("before_byte_size") != F.col("offset"), "offset"), F.when(F.col("_t") != F.col("cumulative"), "cumulative"), F.when(F.col("_n") != F.col("block") + 1, "block_id"),
    ))
    return met.select("block", F.explode(found).alias("problem"))
