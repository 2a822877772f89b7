"""Splitting oversized texts at natural boundaries, with an exact overlap (problem 2).

A hierarchy of boundaries is tried from the strongest to the weakest: ends of the given elements (sections, paragraphs or
sentences, as the text was stored), then ends of punctuation and white space, then any character. Pieces are packed greedily:
each takes the last boundary of the strongest level that its window holds.

Defined cases: a null array and a text within the limit give no pieces; null elements count as empty; a null
`chunk_start_index` gives null piece indexes; rows delivered twice give their pieces once; columns other than the named ones
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks after which a text may be cut when no element ends in the window.
SEPARATORS = "。！？；，、：.!?;,: \n"


def boundary_levels(elements: list[str], separators: str) -> list[np.ndarray]:
    """Cut positions by level, strongest first: element ends, ends of separators."""
    sizes = np.fromiter((len(e) for e in elements), np.int64, len(elements))
    ends = np.unique(np.cumsum(sizes)[sizes > 0])
    codes = np.frombuffer("".join(elements).encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.array(sorted(map(ord, separators)), np.uint32)
    return [ends, np.flatnonzero(np.isin(codes, marks)) + 1]


def pack(length: int, levels: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of that length: greedy, each starting `overlap` before the last one's end."""
    out, start = [], 0
    while length - start > limit:
        end = start + limit
        for cuts in levels:
            k = int(np.searchsorted(cuts, start + limit, "right"))
            if k and cuts[k - 1] > start + overlap:
                end = int(cuts[k - 1])
                break
        out.append((start, end))
        start = end - overlap
    out.append((start, length))
    return out


def split_oversized(chunks: DataFrame, limit: int = 600, overlap: int = 60, separators: str = SEPARATORS) -> DataFrame:
    """chunk_id, piece_no, start_char, end_char, piece_start_index, piece_end_index of each chunk longer than limit.

    The length is summed in the JVM, so only oversized chunks reach Python; each is split by itself, without a shuffle of
    texts. The distinct over the pieces drops those of rows delivered twice.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    size = F.aggregate("source_sentences", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.length(s), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for key, first, raw in zip(b["chunk_id"].to_pylist(), b["chunk_start_index"].to_pylist(), b["source_sentences"].to_pylist()):
                elements = [e or "" for e in raw]
                sizes = np.fromiter((len(e) for e in elements), np.int64, len(elements))
                before = np.cumsum(sizes)
                for n, (s, e) in enumerate(pack(int(before[-1]), boundary_levels(elements, separators), limit, overlap)):
                    a, z = (int(x) for x in np.searchsorted(before, [s, e - 1], "right"))
                    for c, v in zip(cols, (key, n, s, e, None if first is None else first + a, None if first is None else first + z + 1)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=NAMES)

    NAMES = ["chunk_id", "piece_no", "start_char", "end_char", "piece_start_index", "piece_end_index"]
    return (
        chunks.select("chunk_id", "chunk_start_index", "source_sentences")
        .where(F.col("source_sentences").isNotNull() & (size > limit))
        .mapInArrow(run, "chunk_id long, piece_no int, start_char int, end_char int, piece_start_index int, piece_end_index int")
        .distinct()
    )
