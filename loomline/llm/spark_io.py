"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

from loomline.sources.shared import cut, read, scratch, shared_dir, stored

__all__ = ["cut", "read", "scratch", "shared_dir", "slices", "stored"]

#: Python code takes texts in slices of about so many bytes, and so many rows at most, whatever an Arrow batch holds.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of ``rows`` at most whose ``text`` column has about ``size`` bytes, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        offsets = [0]
        total = 0
        for row, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
            if row > offsets[-1] and (total + n > size or row - offsets[-1] == rows):
                offsets.append(row)
                total = 0
            total += n
        for start, end in zip(offsets, [*offsets[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
