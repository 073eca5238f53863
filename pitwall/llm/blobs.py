"""Shuffling fixed-width records as packed arrays.

Sorting hundreds of millions of small records costs most of its time in per-row
work. Here a map task packs its records for each bucket into one binary value, so that
the shuffle moves few large rows, and the task of a bucket works on numpy arrays.
Buckets are taken from the record's hash, so that one frequent key weighs on one bucket
only by its own records; the number of buckets follows the input, which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Records that a map task gathers before it packs them.
FLUSH_BYTES = 12 << 20
SCHEMA = "bucket int, packed binary"


class Packer:
    """Gathers structured records and yields (bucket, packed) batches."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.held.append((bucket, records))
            self.size += records.nbytes
            if self.size >= FLUSH_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket = np.concatenate([b for b, _ in self.held]).astype(np.int32)
        records = np.concatenate([r for _, r in self.held])
        self.held, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, records = bucket[order], records[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        width = records.dtype.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.concatenate([starts, ends[-1:]]) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(records).view(np.uint8))])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), packed], ["bucket", "packed"])


def unpacked(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """All records of a bucket."""
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if data is None or not len(chunk):
            continue
        at = np.frombuffer(offsets, dtype=np.int32 if pa.types.is_binary(chunk.type) else np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(dtype))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def by_bucket(packed: DataFrame, dtype: np.dtype, reduce: Callable[[np.ndarray], pa.Table | None], schema: str) -> DataFrame:
    """Run ``reduce`` on the records of each bucket."""
    dtype = np.dtype(dtype)

    def one(rows: pa.Table) -> pa.Table:
        out = reduce(unpacked(rows.column("packed"), dtype))
        return out

    return packed.groupBy("bucket").applyInArrow(one, schema)


def repeats(values: np.ndarray) -> np.ndarray:
    """Mask over sorted values: those that equal a neighbour."""
    out = np.zeros(len(values), dtype=bool)
    if len(values) > 1:
        same = values[1:] == values[:-1]
        out[1:] |= same
        out[:-1] |= same
    return out
