"""Batches whose bounds depend on what came before: next-fit under several limits, by length, aligned; and retries that halve.

These are folds.  They run a group at a time over ids and sizes alone, as a stream of Arrow batches that are
read in order, so that memory does not grow with the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _folded(rows: DataFrame, by: str, order: list[str], columns: list[str], start: Callable[[], Callable]) -> DataFrame:
    """(by, order, columns, batch): rows of a group in order, each with the batch that step, made anew for each group, deals it to."""
    names = list(dict.fromkeys([by, *order, *columns]))
    ranged = rows.select(*names).repartition(by).sortWithinPartitions(by, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", batch long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, step = object(), None
        for frame in batches:
            dealt = []
            for g, *values in zip(frame[by], *(frame[c] for c in columns)):
                if g != group:
                    group, step = g, start()
                dealt.append(step(*values))
            yield frame.assign(batch=pd.Series(dealt, dtype="int64", index=frame.index))

    return ranged.mapInPandas(fold, schema)


def next_fit(rows: DataFrame, by: str, order: list[str], limits: dict[str, int], most_rows: int | None = None) -> DataFrame:
    """A new batch where the next row would pass a limit on the sum of a column, or on rows; one that passes it alone is a batch."""

    def start() -> Callable:
        batch, held, sums = 0, 0, [0] * len(limits)

        def step(*values) -> int:
            nonlocal batch, held, sums
            if held and (held == most_rows or any(s + v > most for s, v, most in zip(sums, values, limits.values()))):
                batch, held, sums = batch + 1, 0, [0] * len(limits)
            held += 1
            sums = [s + int(v) for s, v in zip(sums, values)]
            return batch

        return step

    return _folded(rows, by, order, list(limits), start)


def by_length(rows: DataFrame, by: str, order: list[str], length: str, most_rows: int, most_cells: int) -> DataFrame:
    """Rows from short to long in padded batches: at most most_rows, and width times rows at most most_cells."""

    def start() -> Callable:
        batch, held, width = 0, 0, 0

        def step(n) -> int:
            nonlocal batch, held, width
            wide = max(width, int(n))
            if held and (held + 1 > most_rows or wide * (held + 1) > most_cells):
                batch, held, wide = batch + 1, 0, int(n)
            held, width = held + 1, wide
            return batch

        return step

    return _folded(rows, by, [length, *order], [length], start)


def aligned(rows: DataFrame, by: str, order: list[str], count: str, size: str, next_size: str, per_block: int, target: int) -> DataFrame:
    """Rows in groups that end at a whole block, where the size reaches the target or the next row would pass it."""

    def start() -> Callable:
        batch, counts, total = 0, 0, 0

        def step(n, s, following) -> int:
            nonlocal batch, counts, total
            own, counts, total = batch, counts + int(n), total + int(s)
            if counts % per_block == 0 and (total >= target or total + int(following) > target):
                batch, counts, total = batch + 1, 0, 0
            return own

        return step

    return _folded(rows, by, order, [count, size, next_size], start)


def bisected(items: list, attempt: Callable[[list], list]) -> tuple[list, list]:
    """(results, failed): attempt on all items; where it fails, on either half, down to single ones that fail for good."""
    waiting, results, failed = [items] if items else [], [], []
    while waiting:
        part = waiting.pop()
        try:
            results += attempt(part)
        except Exception:  # whatever a batch fails with, its halves may not
            if len(part) == 1:
                failed += part
            else:
                waiting += [part[len(part) // 2 :], part[: len(part) // 2]]
    return results, failed
