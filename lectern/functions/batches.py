"""Arrow batches taken apart, so that Python holds a few of a batch's texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are Python's at a time; a batch has up to 10,000 rows or 64 MB.
PIECE_BYTES = 2 << 20


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of the stretches of a batch whose texts have up to `size` bytes together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        yield start, max(stop - start, 1)
        start = max(stop, start + 1)


def rows_by_pieces(batch: pa.RecordBatch, column: str) -> Iterator[list[tuple]]:
    """The rows of a batch, a piece at a time, cut by the bytes of one of its columns."""
    for start, n in pieces(batch.column(column)):
        yield list(zip(*(c.to_pylist() for c in batch.slice(start, n).columns), strict=True))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
