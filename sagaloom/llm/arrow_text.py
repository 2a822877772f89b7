"""Arrow strings as arrays of code points, without an object per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def value_bytes(texts: pa.Array) -> memoryview:
    """The UTF-8 bytes of all texts in a row, out of the array's value buffer; null has none."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return memoryview(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.null_count and (np.diff(offsets)[np.asarray(texts.is_null())] > 0).any():
        return value_bytes(pc.fill_null(texts, ""))
    return memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the length of each text; null has none."""
    lengths = np.asarray(pc.utf8_length(texts).fill_null(0), np.int64)
    return np.frombuffer(str(value_bytes(texts), "utf-8").encode("utf-32-le"), np.uint32), lengths


def slices(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of Arrow batches, in slices of at most slice_bytes of text, or of one text."""
    for b in batches:
        keys, texts, a = b.column(0), b.column(1), 0
        size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + slice_bytes, "right")))
            yield keys.slice(a, z - a), texts.slice(a, z - a)
            a = z
