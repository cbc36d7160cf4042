"""Arrow text as numpy arrays, without a Python string per row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a task; a longer single text is one piece of work.
PIECE = 4_000_000


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in batches of about ``size`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_offsets(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1)
            yield batch.slice(a, min(b, batch.num_rows) - a)
            a = b


def byte_offsets(text: pa.Array) -> np.ndarray:
    """Offsets of the rows in the value buffer of a string array; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    buffer = text.buffers()[1]
    if buffer is None or not len(text):
        return np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(buffer, kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the rows, end to end, and the offsets of the rows in them."""
    offsets = byte_offsets(text)
    data = text.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[:1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points of the rows, end to end; the offsets of the rows in them; the byte offset of each, and the end's."""
    raw, offsets = text_bytes(text)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets, np.arange(len(raw) + 1)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    return points, np.searchsorted(starts, offsets), np.append(starts, len(raw))


def to_text(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The reverse of code_points."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    at = offsets if len(raw) == len(points) else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[offsets]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
