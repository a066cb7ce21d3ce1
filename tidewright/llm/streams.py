"""Arrow helpers shared by the operators that read sorted partitions as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """One table per run of equal values in the first ``keys`` columns of a sorted stream.
    Only the group at hand is kept; the caller sees to it that groups are bounded."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for k in range(keys):
            c = b.column(k)
            differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True)
            both_null = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
            change |= pc.and_not(differs, both_null).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(b.column(k)[lo].as_py() for k in range(keys))
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(b.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


def matrix(lists) -> np.ndarray:
    """The rows of a list column without nulls, all of one length, as a float64 matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1)
