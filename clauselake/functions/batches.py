"""Slices of Arrow batches, so that what a Python worker holds does not grow with the rows and texts of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that a slice has, about.
SLICE_BYTES = 1 << 20


def sliced(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Where neighbouring rows begin and end whose texts have up to `most` bytes together; a larger text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end
