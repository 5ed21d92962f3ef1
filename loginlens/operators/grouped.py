"""Grouped Python work without one Arrow stream per group.

Groups of a few dozen rows cost more to hand over one by one than to compute. Here a
partition holds whole groups in sorted order, passes as one stream of batches, and is cut
where the key changes; a group that spans batches is put together first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

from loginlens.session import spread_evenly

#: Rows of results that are sent back at once.
BATCH = 10_000


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows that agree on the first `keys` columns, a batch each; a null equals a null."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for i in range(keys):
            codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new |= codes[1:] != codes[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(starts, starts[1:]):
            key = tuple(batch.column(i)[low].as_py() for i in range(keys))
            if held and key != last:
                yield _joined(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield _joined(held)


def map_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, dealt: bool = False) -> DataFrame:
    """`work` on every group of rows that agree on `keys`, its rows in the given order and the keys first.

    Rows that are `dealt` lie by the keys already.
    """
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        size = 0
        for group in groups_of(batches, count):
            done.append(work(group))
            size += done[-1].num_rows
            if size >= BATCH:
                yield _joined(done)
                done, size = [], 0
        if done:
            yield _joined(done)

    rest = [c for c in rows.columns if c not in keys]
    placed = rows.select(*keys, *rest)
    placed = placed if dealt else spread_evenly(placed, *keys)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
