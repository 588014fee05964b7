"""What the two searches over vectors share: usable rows, blocks of queries and of rows, and ranking.

Every row whose id is divisible by ``step`` is a query against all rows.  Queries go in blocks of
about ``QUERY_BLOCK``, chosen by a hash of the id.  One block at a time is collected, broadcast and searched; its
results are written to the checkpoint folder and its broadcast is released before the next, so what the
driver and the executors hold does not grow with the data.  A task returns at most k rows a query.  Rows
are scored in blocks of ``ROW_BLOCK``, whatever batches Arrow makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.common import cut, pick

#: Queries that are met by all rows at a time.
QUERY_BLOCK = 2048
#: Rows scored at a time in a task.
ROW_BLOCK = 2048

#: Queries by number of components: their ids and the matrix of their vectors.
Queries = dict[int, tuple[np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, vec array<double>) of rows with an id and a vector of finite numbers; zero: whether a zero vector counts."""
    out = pick(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    out = out.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite))
    return out if zero else out.filter(F.exists("vec", lambda x: x != 0))


def by_blocks(rows: DataFrame, step: int, score: str, search: Callable[[Queries], DataFrame]) -> DataFrame:
    """(query_id, rank, vec_id, score): what search returns for each block of queries, one block after the other.

    Of rows that share an id the smallest vector is the query.
    """
    own = cut(rows.filter(F.col("id") % step == 0).groupBy("id").agg(F.min("vec").alias("vec")))
    blocks = -(-own.count() // QUERY_BLOCK)
    parts = []
    for i in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        found: dict[int, list] = {}
        for row in part.toArrow().to_pylist():
            found.setdefault(len(row["vec"]), []).append((row["id"], row["vec"]))
        parts.append(search({d: (np.array([i for i, _ in x], dtype=np.int64), np.array([v for _, v in x], dtype=np.float64).reshape(len(x), d)) for d, x in found.items()}))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    return reduce(DataFrame.union, parts)


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROW_BLOCK, the last one smaller."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while rows + batch.num_rows >= ROW_BLOCK:
            held.append(batch.slice(0, ROW_BLOCK - rows))
            batch = batch.slice(ROW_BLOCK - rows)
            yield pa.concat_batches(held)
            held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def matrices(batch: pa.RecordBatch, vec: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of components in the batch: places of the rows that have it, and their matrix."""
    column = batch.column(batch.schema.get_field_index(vec))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    sizes, starts = np.diff(ends), ends[:-1] - ends[0]
    for d in np.unique(sizes):
        at = (sizes == d).nonzero()[0]
        yield at, flat[starts[at, None] + np.arange(d)[None, :]]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries of each row, the k with the highest scores, ties to the smaller id, in order."""
    if scores.shape[1] > 4 * k:
        bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        width = int((scores >= bar).sum(axis=1).max())
        part = np.argpartition(scores, scores.shape[1] - width, axis=1)[:, -width:]
        ids, scores = np.take_along_axis(ids, part, 1), np.take_along_axis(scores, part, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


class Kept:
    """The k best entries so far of each query; nothing is the score of no entry, below all others."""

    def __init__(self, queries: np.ndarray, k: int, nothing, dtype):
        self.queries, self.k, self.nothing = queries, k, nothing
        self.ids, self.scores = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), dtype)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Entries as matrices with a row for each query."""
        self.ids, self.scores = best(np.concatenate([self.ids, ids], axis=1), np.concatenate([self.scores, scores], axis=1), self.k)

    def add_pairs(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Entries of the queries at these places; of many those that cannot enter are left aside first."""
        if self.scores.shape[1] == self.k:
            may = scores >= self.scores[at, -1]
            at, ids, scores = at[may], ids[may], scores[may]
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, ids, scores = at[order], ids[order], scores[order]
        who, starts, counts = np.unique(at, return_index=True, return_counts=True)
        place = np.arange(len(at)) - np.repeat(starts, counts)
        wide_ids = np.zeros((len(self.queries), counts.max()), np.int64)
        wide = np.full(wide_ids.shape, self.nothing, self.scores.dtype)
        wide_ids[at, place], wide[at, place] = ids, scores
        self.add(wide_ids, wide)

    def as_batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """A row (query_id, vec_id, score) for each entry."""
        real = self.scores != self.nothing
        query_ids = np.broadcast_to(self.queries[:, None], self.ids.shape)[real]
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids, pa.int64()), pa.array(self.ids[real], pa.int64()), pa.array(self.scores[real]).cast(kind)], names=["query_id", "vec_id", "score"]
        )


def ranked(found: DataFrame, k: int, best_first) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what tasks found for each query."""
    order = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
