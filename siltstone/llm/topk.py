"""Exact top-k by inner product with a uniform threshold in three phases.

The components of a vector are dealt to ``LISTS`` lists; a vector's local score in a list is the inner
product over that list's components, and its score is the sum over the lists.

1. Gather: every task takes, for each query and list, its k highest local scores, resolves what these
   few vectors score in all lists, and returns the k best.  The k-th best score of all is a cutoff which at
   least k vectors reach, so it is safe.
2. The cutoffs of a block of queries are broadcast.  A vector that stays below cutoff / LISTS in every list stays
   below the cutoff in sum, also where scores are negative; every task collects the others, the sufficient
   entries.  A list need not be read to its end: what a vector can still add in the lists to come is at most the product of both
   sides' lengths there (Cauchy and Schwarz), and an entry whose running sum and that bound stay below the cutoff is let go.
3. What remains is resolved exactly, list by list, and the k best of each task that reach the cutoff are returned.

Sums of products are computed in single precision while all of them are integers below 2**24, else in double
precision, below 2**53.  Vectors with a component of 2**20 or more after scaling, and queries with one, are
computed in integers of any size; a score beyond 64 bits counts, and is given, as the nearest 64-bit number.

Edge cases: rows without id, and vectors that are null or hold null or non-finite components, take
no part; a zero vector does; only vectors with the query's number of components are candidates; each of
repeated rows is a candidate, but none with the query's own id; fewer than k candidates give fewer
rows; empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import vectors
from siltstone.llm.common import cut, shared

#: Lists that the components are dealt to.
LISTS = 8
#: Scaled components from which products are computed in integers of any size.
LARGE = 2.0**20
#: The limits of scores, and less than any of them: no entry.
MOST, LEAST, NOTHING = 2**63 - 1, -(2**63) + 2, -(2**63) + 1
#: A cutoff that every score reaches.
NO_CUTOFF = -(2.0**62)
SCHEMA = "query_id long, vec_id long, score long"


def quantised(x: np.ndarray, scale: float = 1024.0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def whole_numbers(x: np.ndarray, scale: int = 1024) -> np.ndarray:
    """The same as integers of any size; a double of 2**53 or more is an integer before it is scaled."""
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(scale * v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def cuts(d: int) -> list[tuple[int, int]]:
    """Where the lists of d components begin and end."""
    ends = np.linspace(0, d, LISTS + 1).astype(int)
    return [(a, b) for a, b in zip(ends[:-1], ends[1:]) if b > a] or [(0, 0)]


class Side:
    """Scaled vectors, with their lengths in each list."""

    def __init__(self, raw: np.ndarray):
        self.x = quantised(raw)
        self.largest = np.abs(self.x).max(axis=1, initial=0)
        self.lists = cuts(raw.shape[1])

    def plain(self) -> np.ndarray:
        return self.largest < LARGE

    def take(self, at: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, lengths by list) of the rows at these places, the lengths rounded up."""
        x = self.x[at]
        lengths = np.sqrt(np.stack([(x[:, a:b] ** 2).sum(axis=1) for a, b in self.lists])) * (1 + 1e-6)
        return (x.astype(np.float32), lengths.astype(np.float32) * np.float32(1 + 1e-6)) if single else (x, lengths)


def dot(q: np.ndarray, x: np.ndarray, who: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, in double precision."""
    out = np.empty(len(who))
    for start in range(0, len(who), 65_536):
        i, j = who[start : start + 65_536], which[start : start + 65_536]
        out[start : start + 65_536] = np.einsum("nd,nd->n", q[i].astype(np.float64), x[j].astype(np.float64))
    return out


def gather(
    kept: vectors.Kept, best_of: list[vectors.Kept], at: np.ndarray, q: np.ndarray, rows: np.ndarray, x: np.ndarray, lists: list[tuple[int, int]]
) -> int:
    """Phase 1 for a block: what enters a list's k highest local scores so far, resolved in all lists; the number of pairs resolved."""
    pairs = []
    for (a, b), own in zip(lists, best_of):
        local = q[:, a:b] @ x[:, a:b].T
        if own.scores.shape[1] < own.k:
            width = min(own.k, len(rows))
            which = np.argpartition(local, len(rows) - width, axis=1)[:, len(rows) - width :]
            who = np.repeat(np.arange(len(q)), width)
            which = which.ravel()
        else:
            who, which = (local > own.scores[:, -1:]).nonzero()
        own.add_pairs(who, rows[which], local[who, which])
        pairs.append(who * len(rows) + which)
    who, which = np.divmod(np.unique(np.concatenate(pairs)), len(rows))
    scores = dot(q, x, who, which).astype(np.int64)
    real = rows[which] != kept.queries[at][who]
    kept.add_pairs(at[who[real]], rows[which[real]], scores[real])
    return len(who)


def resolve(
    kept: vectors.Kept, at: np.ndarray, q: np.ndarray, q_lengths: np.ndarray, rows: np.ndarray, x: np.ndarray, x_lengths: np.ndarray,
    lists: list[tuple[int, int]], cutoffs: np.ndarray,
) -> int:
    """Phases 2 and 3 for a block: sufficient entries whose running bound reaches the cutoff, resolved; the number of pairs resolved."""
    cutoff = cutoffs[at].astype(q.dtype)
    cutoff -= np.abs(cutoff) * 2 * np.finfo(q.dtype).eps  # never above the cutoff itself, nor above a sum that reaches it and was rounded
    enough = cutoff / len(lists)
    enough -= np.abs(enough) * np.finfo(q.dtype).eps
    running, most = None, None
    *before, (last_a, last_b) = lists
    for a, b in before:
        local = q[:, a:b] @ x[:, a:b].T
        if running is None:
            running, most = local, local.copy()
        else:
            running += local
            np.maximum(most, local, out=most)
    # the last list is computed for those alone that can still reach the cutoff
    bound = q_lengths[-1][:, None] * x_lengths[-1][None, :]
    if running is None:
        alive = bound >= cutoff[:, None]
    else:
        np.maximum(most, bound, out=most)
        alive = most >= enough[:, None]
        bound += running
        alive &= bound >= cutoff[:, None]
    who, which = alive.nonzero()
    rest = dot(q[:, last_a:last_b], x[:, last_a:last_b], who, which)
    scores = (rest if running is None else rest + running[who, which]).astype(np.int64)
    real = (scores >= cutoffs[at][who]) & (rows[which] != kept.queries[at][who])
    kept.add_pairs(at[who[real]], rows[which[real]], scores[real])
    return len(who)


def exact(kept: vectors.Kept, at: np.ndarray, raw_q: np.ndarray, rows: np.ndarray, raw_x: np.ndarray) -> None:
    """Pairs with a large component on either side, in integers of any size."""
    q, x = whole_numbers(raw_q), whole_numbers(raw_x)
    for i, own in zip(at.tolist(), q):
        scores = np.array([min(MOST, max(LEAST, int(s))) for s in (x @ own if x.shape[1] else np.zeros(len(x), int))], dtype=np.int64)
        real = rows != kept.queries[i]
        kept.add_pairs(np.full(real.sum(), i), rows[real], scores[real])


def scan(batches, queries: vectors.Queries, k: int, cutoffs: dict[int, np.ndarray] | None, count: list[int] | None = None):
    """The k best of a task for each query: of gathered lists, or, given cutoffs, of what reaches them.

    count, if given, is told the pairs met and the pairs resolved.
    """
    kept = {d: vectors.Kept(ids, k, NOTHING, np.int64) for d, (ids, _) in queries.items()}
    sides = {d: Side(q) for d, (_, q) in queries.items()}
    # of each list one more than k, as one may be the query itself
    best_of = {d: [vectors.Kept(queries[d][0][side.plain()], k + 1, -np.inf, np.float64) for _ in side.lists] for d, side in sides.items()}
    for batch in vectors.row_blocks(batches):
        own = batch.column(0).to_numpy(zero_copy_only=False)
        for at, raw in vectors.matrices(batch):
            d = raw.shape[1]
            if d not in queries:
                continue
            rows, side, q = own[at], Side(raw), sides[d]
            plain_q, plain_x = q.plain().nonzero()[0], side.plain().nonzero()[0]
            large_q, large_x = (~q.plain()).nonzero()[0], (~side.plain()).nonzero()[0]
            if len(large_q):
                exact(kept[d], large_q, queries[d][1][large_q], rows, raw)
            if len(large_x) and len(plain_q):
                exact(kept[d], plain_q, queries[d][1][plain_q], rows[large_x], raw[large_x])
            if not len(plain_q) or not len(plain_x):
                continue
            single = float(q.largest[plain_q].max()) * float(side.largest[plain_x].max()) * max(1, d) < 2.0**24
            (qs, q_lengths), (xs, x_lengths) = q.take(plain_q, single), side.take(plain_x, single)
            if cutoffs is None:
                done = gather(kept[d], best_of[d], plain_q, qs, rows[plain_x], xs, q.lists)
            else:
                done = resolve(kept[d], plain_q, qs, q_lengths, rows[plain_x], xs, x_lengths, q.lists, cutoffs[d])
            if count is not None:
                count[0] += len(plain_q) * len(plain_x)
                count[1] += done
    for own in kept.values():
        yield own.as_batch(pa.int64())


def top_k(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, step: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score) for the k highest integer inner products of each query."""
    rows = vectors.usable(table, id_col, vec_col, zero=True)

    def search(block: vectors.Queries) -> DataFrame:
        told = shared(block)
        lists = rows.mapInArrow(lambda batches: scan(batches, told.value, k, None), SCHEMA)
        kth = vectors.ranked(lists, k, F.desc("score")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        known = {r.query_id: r.kth for r in kth.filter(F.col("n") == k).collect()}
        cutoffs = shared({d: np.array([known.get(int(i), NO_CUTOFF) for i in ids], dtype=np.float64) for d, (ids, _) in block.items()})
        found = cut(vectors.ranked(rows.mapInArrow(lambda batches: scan(batches, told.value, k, cutoffs.value), SCHEMA), k, F.desc("score")))
        told.destroy()
        cutoffs.destroy()
        return found

    return vectors.by_blocks(rows, step, "long", search)
