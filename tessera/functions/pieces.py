"""Arrow batches in pieces: a batch has up to ten thousand rows, whatever their size, and as Python values they take many times that."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: At most so many rows, and about so many bytes, are taken out of Arrow at once.
ROWS, BYTES = 2048, 1 << 22


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
