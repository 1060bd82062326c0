"""Arrow batches in pieces of bounded size, so what a Python task holds doesn't grow with rows or texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of a piece; a single row is never cut.
ROWS, BYTES = 256, 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, at most `rows` and about `size` bytes at a time."""
    for b in batches:
        todo = [b.slice(i, rows) for i in range(b.num_rows - 1 - (b.num_rows - 1) % rows, -1, -rows)] if b.num_rows else []
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > size:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece
