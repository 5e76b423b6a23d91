"""Arrow batches cut to a bounded amount of text, so that a task's memory does not depend on row sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once (one longer text is worked on alone).
TEXT_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most `limit` bytes together, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with these columns at the end; columns of the same name are replaced."""
    kept = [n for n in batch.schema.names if n not in columns]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=kept + list(columns))


def out_schema(df, **types):
    """Spark schema of `with_columns` over the rows of df."""
    from pyspark.sql.types import StructField, StructType

    kept = [f for f in df.schema.fields if f.name not in types]
    return StructType(kept + [StructField(n, t, True) for n, t in types.items()])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
