"""Approximate nearest neighbours by score-aware anisotropic quantisation.

For a query q the nearest vector x is that with the largest q.x - |x|^2 / 2, a maximum inner product search
with a known constant for each x.  Vectors are quantised to four bits for each two components.  The loss
weighs the part of the residual that is parallel to x by ``eta`` against the rest, as an error along x moves
the inner products of just those queries for which x scores high.  Codebooks are trained by alternating
coordinate descent over codes with one least-squares solution for all centres under that loss.

A search scans tables: for each byte of codes a query has 256 sums of two centres' products, and a
vector's estimate is the sum of the entries that its bytes name.  Of each ``ROW_BLOCK`` rows, whatever batches they
came in, the ``rerank`` best by estimate are measured exactly, in double precision on the original vectors; of a
smaller block the same share, and more than k.

The codebooks are fitted on at most ``sample`` vectors, those first by a hash of their id; every row is
indexed, and the index, codes beside vectors, is written to the checkpoint folder.

Edge cases: rows without id, and vectors that are null, zero, or hold null or non-finite components, take no
part; the codebooks are for the commonest number of components, vectors with another, and those with a component
over ``FAR`` times the sample's median length, have no codes and are compared exactly, as is all with queries of that kind;
differences whose squares leave the range of doubles are measured after scaling, and a distance beyond that range
counts as the largest double; each of repeated rows is a candidate, but none with the query's own id; fewer
than k candidates give fewer rows; empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import vectors
from siltstone.llm.common import cut, shared

#: Cosine above which scores matter, in the weight of the parallel residual.
THRESHOLD = 0.2
CENTRES = 16
#: Components beyond so many median lengths are left to exact comparison.
FAR = 1e6


def _pairs(x: np.ndarray) -> np.ndarray:
    """Vectors as (row, subspace, 2); subspaces are even in number, padded with zeros."""
    d = x.shape[1]
    wide = np.zeros((len(x), -(-d // 4) * 4))
    wide[:, :d] = x
    return wide.reshape(len(x), -1, 2)


def eta(d: int) -> float:
    """Weight of the parallel residual against the rest, for unit vectors in d dimensions."""
    return max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def assign(x: np.ndarray, books: np.ndarray, weight: float, passes: int = 2) -> np.ndarray:
    """Codes (row, subspace) by coordinate descent on the anisotropic loss, from the nearest centres."""
    norm = np.sqrt((x**2).sum(axis=(1, 2), keepdims=True))
    along = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    errors = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=-1)
    codes = errors.argmin(axis=2)
    shares = np.einsum("nsd,nscd->nsc", along, x[:, :, None, :] - books[None], optimize=True)
    at = np.arange(len(x))
    parallel = np.take_along_axis(shares, codes[:, :, None], 2).sum(axis=(1, 2))
    for _ in range(passes):
        for s in range(x.shape[1]):
            rest = parallel - shares[at, s, codes[:, s]]
            codes[:, s] = (errors[:, s] + (weight - 1) * (rest[:, None] + shares[:, s]) ** 2).argmin(axis=1)
            parallel = rest + shares[at, s, codes[:, s]]
    return codes


def train(x: np.ndarray, rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Codebooks (subspace, centre, 2)."""
    weight, x = eta(x.shape[1]), _pairs(x)
    n, subspaces, _ = x.shape
    random = np.random.default_rng(seed)
    books = x[random.integers(0, n, (subspaces, CENTRES)), np.arange(subspaces)[:, None]].copy()
    for _ in range(8):  # plain k-means in each subspace to begin with
        codes = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=-1).argmin(axis=2)
        for s in range(subspaces):
            counts = np.bincount(codes[:, s], minlength=CENTRES)
            sums = np.stack([np.bincount(codes[:, s], x[:, s, e], CENTRES) for e in (0, 1)], axis=1)
            books[s] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], books[s])
    norm = np.sqrt((x**2).sum(axis=(1, 2), keepdims=True))
    along = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    size = subspaces * CENTRES * 2
    for _ in range(rounds):
        codes = assign(x, books, weight)
        place = (np.arange(subspaces)[None, :] * CENTRES + codes)[:, :, None] * 2 + np.arange(2)
        gram, right, counts = np.zeros((size, size)), np.zeros(size), np.zeros(size)
        for start in range(0, n, 2048):
            p, a, v = place[start : start + 2048].reshape(-1, subspaces * 2), along[start : start + 2048], x[start : start + 2048]
            wide = np.zeros((len(p), size))
            np.put_along_axis(wide, p, a.reshape(len(p), -1), axis=1)
            gram += (weight - 1) * wide.T @ wide
            np.add.at(right, p.ravel(), weight * v.ravel())
            counts += np.bincount(p.ravel(), minlength=size)
        gram[np.arange(size), np.arange(size)] += counts + 1e-6
        solved = np.linalg.solve(gram, right + 1e-6 * books.ravel())
        books = np.where(counts > 0, solved, books.ravel()).reshape(books.shape)
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(byte of the codes, its value, query): products of a query with the two centres that the value names."""
    each = np.einsum("qsd,scd->scq", _pairs(q), books, optimize=True).astype(np.float32)
    return (each[0::2, :, None, :] + each[1::2, None, :, :]).reshape(len(books) // 2, 256, len(q))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances over the last axis."""
    with np.errstate(over="ignore"):
        gaps = np.abs(x - q)
        squares = (gaps**2).sum(axis=-1)
        odd = ~((squares > 1e-280) & (squares < 1e300))
        out = np.sqrt(squares)
        if odd.any():
            part = gaps[odd]
            largest = part.max(axis=-1, keepdims=True, initial=0)
            ratio = np.divide(part, largest, out=np.zeros_like(part), where=(largest > 0) & np.isfinite(largest))
            out[odd] = largest[:, 0] * np.sqrt((ratio**2).sum(axis=-1))
    return np.where(np.isfinite(out), out, np.finfo(np.float64).max)


def measure(kept: vectors.Kept, at: np.ndarray, q: np.ndarray, rows: np.ndarray, x: np.ndarray, chosen: np.ndarray | None) -> None:
    """Exact distances of the queries at these places to the rows that are chosen for each, or to all."""
    step = max(1, 2_000_000 // max(1, x.shape[1] * (len(rows) if chosen is None else chosen.shape[1])))
    found, scores = [], []
    for start in range(0, len(at), step):
        part = slice(start, start + step)
        which = np.broadcast_to(np.arange(len(rows)), (len(at[part]), len(rows))) if chosen is None else chosen[part]
        found.append(rows[which])
        scores.append(-distances(x[which], q[part, None, :]))
    found, scores = np.concatenate(found), np.concatenate(scores)
    scores[found == kept.queries[at][:, None]] = -np.inf
    if len(at) == len(kept.queries):
        kept.add(found, scores)
    else:
        who, which = (scores != -np.inf).nonzero()
        kept.add_pairs(at[who], found[who, which], scores[who, which])


@dataclass
class Codebooks:
    """For vectors of d components, divided by scale; centres is None where there is nothing to learn from."""

    d: int
    scale: float
    centres: np.ndarray | None

    def fits(self, x: np.ndarray) -> np.ndarray:
        """Which vectors have codes, or tables."""
        if self.centres is None or x.shape[1] != self.d:
            return np.zeros(len(x), dtype=bool)
        return np.abs(x).max(axis=1, initial=0) <= FAR * self.scale


def fit(sample: list[list[float]]) -> Codebooks:
    if not sample:
        return Codebooks(0, 1.0, None)
    d = min(Counter(map(len, sample)).items(), key=lambda x: (-x[1], x[0]))[0]
    x = np.array([v for v in sample if len(v) == d], dtype=np.float64).reshape(-1, d)
    scale = float(np.median(distances(x, np.zeros(d))))
    own = Codebooks(d, scale, np.zeros(0))
    near = own.fits(x)
    return Codebooks(d, scale, train(x[near] / scale) if d and near.any() else None)


def build_index(rows: DataFrame, sample: int = 8192) -> tuple[DataFrame, Codebooks]:
    """The index (id, vec, norm, codes) of all usable rows, and the codebooks it is made with; norm is that of the scaled vector, squared."""
    first = rows.select("vec").orderBy(F.xxhash64("id", F.lit("ann")), "id").limit(sample).toArrow().to_pylist()
    books = fit([r["vec"] for r in first])
    told = shared(books)

    def coded(batches):
        books = told.value
        for batch in vectors.row_blocks(batches):
            norms, codes = np.zeros(batch.num_rows), [None] * batch.num_rows
            for at, x in vectors.matrices(batch):
                near = books.fits(x)
                if near.any():
                    at, x = at[near], x[near] / books.scale
                    norms[at] = (x**2).sum(axis=1)
                    for i, row in zip(at, packed(assign(_pairs(x), books.centres, eta(books.d)))):
                        codes[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(norms), pa.array(codes, pa.binary())], names=["id", "vec", "norm", "codes"]
            )

    return cut(rows.mapInArrow(coded, "id long, vec array<double>, norm double, codes binary")), books


def estimates(norms: np.ndarray, codes: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """(row, query): q.x - |x|^2 / 2 as the tables have it."""
    out = np.repeat((-0.5 * norms).astype(np.float32)[:, None], lookup.shape[2], axis=1)
    for byte in range(codes.shape[1]):
        out += lookup[byte][codes[:, byte]]
    return out


def scan(batches, queries: vectors.Queries, books: Codebooks, k: int, rerank: int):
    """The k nearest of a task for each query, as negative distances."""
    kept = {d: vectors.Kept(ids, k, -np.inf, np.float64) for d, (ids, _) in queries.items()}
    near_q = {d: books.fits(q) for d, (_, q) in queries.items()}
    lookup = tables(queries[books.d][1][near_q[books.d]] / books.scale, books.centres) if books.d in queries and near_q[books.d].any() else None
    for batch in vectors.row_blocks(batches):
        own, norms = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
        has_codes = np.asarray(batch.column(3).is_valid())
        for at, x in vectors.matrices(batch):
            d = x.shape[1]
            if d not in queries:
                continue
            q, held = queries[d][1], kept[d]
            with_tables, without = near_q[d].nonzero()[0], (~near_q[d]).nonzero()[0]
            if len(without):
                measure(held, without, q[without], own[at], x, None)
            if not len(with_tables):
                continue
            coded = has_codes[at]
            if not coded.all():
                measure(held, with_tables, q[with_tables], own[at[~coded]], x[~coded], None)
            at, x = at[coded], x[coded]
            if len(at):
                most = max(k + 1, -(-rerank * len(at) // vectors.ROW_BLOCK))
                chosen = None
                if most < len(at):
                    codes = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                    chosen = np.argpartition(estimates(norms[at], codes, lookup), len(at) - most, axis=0)[len(at) - most :].T
                measure(held, with_tables, q[with_tables], own[at], x, chosen)
    for held in kept.values():
        yield held.as_batch(pa.float64())


def search(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, step: int = 100, sample: int = 8192, rerank: int = 128
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest found, by Euclidean distance."""
    rows = vectors.usable(table, id_col, vec_col, zero=False)
    index, books = build_index(rows, sample)

    def one_block(block: vectors.Queries) -> DataFrame:
        told = shared((block, books))
        found = vectors.ranked(index.mapInArrow(lambda batches: scan(batches, *told.value, k, rerank), "query_id long, vec_id long, score double"), k, F.desc("score"))
        found = cut(found.withColumn("score", F.abs("score")))
        told.destroy()
        return found

    return vectors.by_blocks(rows, step, "double", one_block)
