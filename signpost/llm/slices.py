"""Arrow batches cut into parts of bounded size, for workers that open texts up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose texts hold about ``max_bytes``, a longer text alone; no row is lost."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64) + 64)
    lo, done = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, done + max_bytes, "right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(total[hi - 1])


def lists_of(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive ``sizes`` of ``values`` as one list each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)
