"""Work on blocks of rows in Python: Arrow batches are cut so that memory follows the text, not the row count."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Cut and join Arrow batches to tables of about ``most_bytes`` of ``column``; one row may have more."""
    held, size = [], 0
    for batch in batches:
        lengths = batch.column(column).nbytes and _lengths(batch.column(column))
        start = 0
        for i in range(batch.num_rows):
            size += lengths[i] if lengths is not None and len(lengths) else 0
            if size >= most_bytes:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Give freed memory back to the system, when a task is done: Python workers are reused by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


class Vocabulary(dict):
    """word -> number; unknown words get the next number and wait in ``new``."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[starts[i] : starts[i] + lengths[i]]``, joined."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def varints(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 35 in 7-bit groups, low group first; 128 marks that another follows."""
    values = values.astype(np.uint64)
    count = 1 + sum((values >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = count > k
        low = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - count)[has] + k] = low.astype(np.uint8) | np.where(count[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unvarints(data: bytes) -> np.ndarray:
    """Back from ``varints`` to int64."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)
