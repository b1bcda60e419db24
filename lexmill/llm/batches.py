"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a part holds.
PART_BYTES = 1 << 20


def parts(batches: Iterator[pa.RecordBatch], *texts: str, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices whose text columns hold at most `size` bytes together, or one row
    that holds more. What is made of a slice in Python is then bounded by bytes, however many rows a batch has."""
    for batch in batches:
        weight = np.zeros(batch.num_rows, np.int64)
        for c in texts:
            weight += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(weight), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end
