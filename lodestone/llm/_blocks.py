"""Arrays packed into binary blocks, one for each part that they are dealt to."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives the memory that it freed back to the system when it ends: Python workers stay for later tasks, and would keep their largest size."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return tidy


def packed(key: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks of columns, one for each value of key modulo parts."""
    where = (key % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.uint32)
    order = np.argsort(where, kind="stable")
    found, start = np.unique(where[order], return_index=True)
    columns = [c[order] for c in columns]
    for k, i, j in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
        yield k, b"".join([np.int64(j - i).tobytes(), *(c[i:j].tobytes() for c in columns)])


def unpacked(blocks: list[bytes], *kinds: str) -> list[np.ndarray]:
    out = [[] for _ in kinds]
    for x in blocks:
        n, at = int(np.frombuffer(x, np.int64, 1)[0]), 8
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def _blocks(kind: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([kind] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "kind", "block"])


BLOCKS = "part int, kind int, block binary"
