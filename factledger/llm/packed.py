"""Packed shuffles: rows of (bucket, kind, payload), where a payload holds the columns of many records.

A payload is one compressed Arrow batch, so the shuffle moves few, dense rows. Buckets are bounded in bytes by
their number, and a task sees the payloads of a bucket in the order of their kind.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, kind int, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def pack(columns: dict) -> bytes:
    batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_next_batch()


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], schema=ARROW)


def split(bucket: np.ndarray, columns: dict[str, np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """One payload for each bucket that has records."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    of = bucket[order]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(of)], strict=True):
        at = order[a:b]
        yield int(of[a]), kind, pack({k: v[at] for k, v in columns.items()})


class Sender:
    """Gathers records and lets them go as payloads once there are enough of them."""

    def __init__(self, kind: int, limit: int = 1 << 18) -> None:
        self.kind, self.limit, self.held, self.n = kind, limit, [], 0

    def add(self, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket, columns))
            self.n += len(bucket)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            names = self.held[0][1]
            found = list(split(np.concatenate([b for b, _ in self.held]), {k: np.concatenate([c[k] for _, c in self.held]) for k in names}, self.kind))
            self.held, self.n = [], 0
            for i in range(0, len(found), 64):
                yield rows(found[i : i + 64])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, its (kind, payload) pairs) from rows sorted by bucket and kind; pairs are read as they come."""
    flat = ((b, k, p) for batch in batches for b, k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2)), strict=True))
    held = next(flat, None)
    while held is not None:
        bucket = held[0]

        def own() -> Iterator[tuple[int, bytes]]:
            nonlocal held
            while held is not None and held[0] == bucket:  # noqa: B023
                yield held[1], held[2]
                held = next(flat, None)

        pairs = own()
        yield bucket, pairs
        for _ in pairs:
            pass


def frugal(work: Callable) -> Callable:
    """`work`, after which the worker gives freed memory back: it stays alive, idle or for the next stage, beside the JVM."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return go


def deal(df: DataFrame, parts: int, work: Callable, schema: str) -> DataFrame:
    """`work` on each partition of whole buckets, sorted by bucket and kind."""
    return df.repartition(parts, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(frugal(work), schema)


def texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null as empty."""
    col = batch.column(name)
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pa.compute.fill_null(col, b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b
