"""Folds over the rows of a key, many keys at a time.

Where a step's result feeds the next one a key is a fold; keys are many and short, so a
step is taken for all keys of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Of fewer keys than this a step costs less in plain Python.
FEW = 16


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where another key begins, in rows sorted by it; nulls are one key."""
    code = column.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def folded(rows: DataFrame, key: str, order: list[Column], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """run(rows, starts) over batches of whole keys, each key's rows in order.

    A key that goes on in the next batch waits for it, so a task holds a batch and a key.
    """
    def batches(found):
        held = []
        for batch in found:
            if not batch.num_rows:
                continue
            if held and batch.column(key)[0].as_py() == held[-1].column(key)[-1].as_py() == batch.column(key)[-1].as_py():
                held.append(batch)  # one key from end to end
                continue
            t = pa.Table.from_batches([*held, batch])
            starts = _starts(t.column(key))
            if starts[-1]:
                yield from run(t.slice(0, starts[-1]), starts[:-1]).to_batches()
            held = t.slice(starts[-1]).to_batches()
        if held:
            yield from run(pa.Table.from_batches(held), np.zeros(1, np.int64)).to_batches()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(batches, schema)


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    return t.column(name).cast(pa.float64()).to_numpy()


def alike(counts: np.ndarray, starts: np.ndarray):
    """For keys of one count each: (count, places of their rows, a row a key)."""
    order = np.argsort(counts, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(counts[order])) + 1):
        if len(part):
            yield int(counts[part[0]]), starts[part][:, None] + np.arange(counts[part[0]])
