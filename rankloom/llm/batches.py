"""Arrow batches cut short, so that few texts are Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def short(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
