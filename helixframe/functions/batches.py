"""Arrow batches cut so that what a task makes of one at a time is bounded by bytes, not by rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 1 << 19


def row_bytes(column) -> np.ndarray:
    """About how many bytes each row of a column takes; lists count with what they hold."""
    kind = column.type
    if pa.types.is_list(kind):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = np.concatenate([[0], np.cumsum(row_bytes(column.flatten()))])
        return np.diff(inner[np.concatenate([[0], np.cumsum(n)])])
    if pa.types.is_struct(kind):
        return sum((row_bytes(column.field(k)) for k in range(kind.num_fields)), np.zeros(len(column), np.int64))
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def bounded(batches, most: int | None = None):
    """The batches in slices of about ``most`` bytes, of one row at least; an empty batch stays."""
    most = most or MOST_BYTES
    for batch in batches:
        held = np.cumsum(sum((row_bytes(c) for c in batch.columns), np.zeros(batch.num_rows, np.int64)))
        start = 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(held, (held[start - 1] if start else 0) + most, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end
        if not batch.num_rows:
            yield batch
