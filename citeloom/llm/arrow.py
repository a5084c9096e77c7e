"""Small helpers for mapInArrow functions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tidy(run, after=None):
    """A function for mapInArrow that gives its memory back when its task ends.

    Workers live on and serve other operators; without this each would keep
    the most that any of them ever needed. after: called first, to drop caches.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, target: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than target bytes of the column (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(column).nbytes
        if size <= target:
            yield batch
            continue
        lengths = np.asarray([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + target, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value per length, cut from the bytes of data in order."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the size of each value."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], np.diff(at)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, with the offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def compact_text(column: pa.Array) -> pa.Array:
    """The column as large strings in a buffer of its own, null as empty."""
    raw, at = utf8_bytes(column)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(raw))])


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch and then the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(new.values()), names=[*keep, *new])


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in batches sorted by integer keys, whole even across batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
