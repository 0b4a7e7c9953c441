"""Rows sorted by a key, read as runs of equal keys across Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts): rows of whole runs only, and where each run starts; the last run waits for the next batch.

    Memory is one batch and one run; callers bound their runs by splitting hot keys beforehand.
    """
    kept: list[pa.RecordBatch] = []
    last = None

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if last is not None and first == last and ends == last:
            kept.append(batch)
            continue
        table = pa.Table.from_batches([*kept, batch]).combine_chunks()
        starts = cut(table)
        whole = table.slice(0, int(starts[-1]))
        if len(whole):
            yield whole, starts[:-1]
        kept, last = table.slice(int(starts[-1])).to_batches(), ends
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, cut(table)
