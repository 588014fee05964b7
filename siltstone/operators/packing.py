"""Token streams packed into sequences, blocks and shards, by arithmetic on running sums of lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.ordered import running


def positions(docs: DataFrame, by: list[str], order: list[str], length: str) -> DataFrame:
    """docs with ``start`` and ``end``, each document's interval in its group's stream."""
    placed = running(docs, by, order, [length])
    return placed.withColumn("start", F.col(f"before_{length}")).withColumn("end", F.col("start") + F.col(length)).drop(f"before_{length}", "number")


def owner(position: Column, context: int) -> Column:
    """The sequence that a stream position is attributed to; each later sequence begins with the last one's final token."""
    return F.when(position <= 0, F.lit(0)).otherwise(F.floor((position - 1) / context)).cast("long")


def incidence(placed: DataFrame, context: int) -> DataFrame:
    """A row for each document and sequence that holds some of it: ``seq`` and ``tokens``, those attributed to the sequence."""
    held = placed.filter("end > start")
    seqs = held.withColumn("seq", F.explode(F.sequence(owner(F.col("start"), context), owner(F.col("end") - 1, context))))
    first = F.when(F.col("seq") == 0, F.lit(0)).otherwise(F.col("seq") * context + 1)
    last = (F.col("seq") + 1) * context + 1
    return seqs.withColumn("tokens", F.least("end", last) - F.greatest("start", first))


def sequence_count(total: Column, context: int) -> Column:
    """Sequences that a stream of total tokens fills, the last one padded."""
    return F.when(total <= 0, F.lit(0)).otherwise(F.floor((total - 1) / context) + 1).cast("long")


def block_of(seq: Column, per_block: int) -> Column:
    return F.floor(seq / per_block).cast("long")


def shard_of(block: Column, block_bytes: int, target_bytes: int) -> Column:
    return F.floor(block / max(1, target_bytes // block_bytes)).cast("long")


def windows(docs: DataFrame, tokens: str, context: int, end_token: int, pad: int) -> DataFrame:
    """Each document, ended once by end_token, in windows of context + 1 tokens at a stride of context.

    Columns ``window``, ``valid_targets`` and ``window_tokens`` are added; a document of one token has none.
    """
    ended = F.when(F.element_at(tokens, -1) == end_token, F.col(tokens)).otherwise(F.array_append(tokens, F.lit(end_token)))
    own = docs.filter(F.size(tokens) > 0).withColumn(tokens, ended).filter(F.size(tokens) > 1)
    own = own.withColumn("window", F.explode(F.sequence(F.lit(0), F.ceil((F.size(tokens) - 1) / context).cast("int") - 1)))
    part = F.slice(tokens, F.col("window") * context + 1, context + 1)
    own = own.withColumn("window_tokens", part).withColumn("valid_targets", F.size("window_tokens") - 1)
    return own.withColumn("window_tokens", F.concat("window_tokens", F.array_repeat(F.lit(pad), context + 1 - F.size("window_tokens"))))


def next_fit(records: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """(by, order, size, block): records in order, never split, a new block where the next one does not fit.

    This is a fold: what a block holds depends on where the last one ended.  It runs a group at a time
    over ids and sizes alone, as a stream of Arrow batches that are read in order, so that memory does not grow with the group.
    """
    ranged = records.select(by, order, size).repartition(by).sortWithinPartitions(by, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", block long"

    def folded(batches):
        group, block, held = object(), 0, 0
        for batch in batches:
            blocks = []
            for g, n in zip(batch[by], batch[size]):
                if n > most:
                    raise ValueError(f"a record of {n} exceeds the block size {most}")
                if g != group:
                    group, block, held = g, 0, 0
                if held and held + n > most:
                    block, held = block + 1, 0
                held += n
                blocks.append(block)
            yield batch.assign(block=blocks)

    return ranged.mapInPandas(folded, schema)
