"""Texts of Arrow batches as flat byte arrays, for operators that work on bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs whose `column` holds at most `limit` bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other (null: none), and where each text begins (and the last one ends)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, places, content = texts.buffers()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8)[at[0] : at[-1]] if content is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def runs(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true cells; a run never crosses one of the `borders` (positions, ascending)."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = borders[(borders > 0) & (borders < len(inside))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def strings(data: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    """Arrow strings that lie gapless in `data`, from where each ends."""
    places = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])
