"""Evaluation texts leaking into training text, by winnowing (problem 9).

Texts are reduced to their folded letters and digits. Every position has the hash of the k letters from it on, k longer for
alphabets than for ideographs; of each window of w neighbours the least hash is kept as a fingerprint, on both sides, so every
shared span of at least w + k - 1 letters shares one. Fingerprints of a document that an item has too are extended letter by
letter in both directions. Extended spans that follow each other in document and item with a small gap (replaced words) become
one stretch; a span joins any stretch still within reach. A stretch counts if 0.6 of it is in such spans and if it is a fifth of
the item (shorter ones are stock phrases or snippets); the stretches that count must cover half of the item. So the spans of a
leak hold 0.3 of the item's letters, its fingerprints a number that follows from it, and pairs with less are not chained.

The items are the small side. Their index is sent to the executors in blocks of bounded size, each block in one pass over the
corpus and one block at a time on the driver, so any number of items works and no corpus fingerprint is ever shuffled.

Defined cases: null and empty texts on either side, and items of fewer than k letters, match nothing; rows delivered twice
give their pair once; several items may match one document and the reverse.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaloom.llm.arrow_text import code_points, slices
from sagaloom.llm.letters import letter_table

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WIDE = 0x2E80


@lru_cache(1)
def _table() -> np.ndarray:
    return letter_table(keep="LN")


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded letters of all texts in a row, and where each text starts (one more entry than texts)."""
    codes, lengths = code_points(texts)
    fold = _table()[codes]
    kept = np.concatenate([[0], np.cumsum(fold > 0)])
    return fold[fold > 0], kept[np.concatenate([[0], np.cumsum(lengths)])]


def fingerprints(letters: np.ndarray, bounds: np.ndarray, k_wide: int, k_narrow: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed fingerprints."""
    n = len(letters)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, int(n).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(0x1F3)) * up[:n], dtype=np.uint64)])
    wide = letters >= _WIDE
    k = np.where(wide, k_wide, k_narrow)
    at = np.arange(n)
    end = np.repeat(bounds[1:], np.diff(bounds))
    full = at + k <= end
    to = np.where(full, at + k, at)
    h = (sums[to] - sums[:-1]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h[~full] = _NONE
    pad = np.concatenate([h, np.full(window - 1, _NONE, np.uint64)])
    least, span = pad, 1
    while span < window:  # minima of windows, by doubling
        step = min(span, window - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    chosen, open_ = np.zeros(n + window - 1, bool), least != _NONE
    for o in range(window - 1, -1, -1):
        hit = open_ & (pad[o : o + n] == least[:n])
        chosen[np.flatnonzero(hit) + o] = True
        open_ &= ~hit
    p = np.flatnonzero(chosen[:n])
    return p, h[p]


class ItemIndex:
    """Letters and fingerprints of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], k_wide: int, k_narrow: int, window: int):
        self.ids = np.array(ids, np.int64)
        self.letters, self.bounds = letters_of(pa.array(texts, pa.string()))
        p, h = fingerprints(self.letters, self.bounds, k_wide, k_narrow, window)
        order = np.argsort(h, kind="stable")
        self.place, self.hash = p[order], h[order]
        self.item_of = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hash >> np.uint64(44)).astype(np.int64)] = True


def _extend(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many letters a and b go on alike from i and j in the direction of step, before the given ends."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = i[live] + step * n[live], j[live] + step * n[live]
        ok = (x < a_end[live]) & (y < b_end[live]) if step > 0 else (x >= a_end[live]) & (y >= b_end[live])
        ok[ok] = a[x[ok]] == b[y[ok]]
        live = live[ok]
        n[live] += 1
    return n


def _groups(new: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Starts of groups, new telling for each row but the first whether it starts one, and their sums for each row."""
    start = np.concatenate([[0], np.flatnonzero(new) + 1])
    size = np.diff(np.append(start, len(new) + 1))
    return start, lambda x: np.repeat(np.add.reduceat(x, start), size)


def _each(f: np.ufunc, x: np.ndarray, new: np.ndarray) -> np.ndarray:
    start, _ = _groups(new)
    return np.repeat(f.reduceat(x, start), np.diff(np.append(start, len(x))))


def leaks(
    texts: pa.Array, index: ItemIndex, k_wide: int, k_narrow: int, window: int, least_stretch: float, least_cover: float, density: float = 0.6
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and covered share of each leak in an Arrow string array."""
    letters, bounds = letters_of(texts)
    p, h = fingerprints(letters, bounds, k_wide, k_narrow, window)
    may = index.sieve[(h >> np.uint64(44)).astype(np.int64)]
    p, h = p[may], h[may]
    lo, hi = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
    many = hi - lo
    j = index.place[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    i = np.repeat(p, many)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # a span of n letters that is found holds n / (window + k - 1) fingerprints of the item at least, and the spans of a
    # leak hold density * least_cover of the item
    row = np.searchsorted(bounds, i, "right") - 1
    item = index.item_of[j]
    k = np.where(letters[i] >= _WIDE, k_wide, k_narrow)
    whole = np.diff(index.bounds)
    order = np.argsort(row * len(index.letters) + j, kind="stable")
    i, j, row, item, k = i[order], j[order], row[order], item[order], k[order]
    same = row[1:] == row[:-1]
    _, sums = _groups(~same | (item[1:] != item[:-1]))
    once = np.append(True, ~same | (j[1:] != j[:-1]))
    ok = sums((k + window - 1.0) * once) >= density * least_cover * whole[item]
    # fingerprints one after another on a diagonal lie in one span: the first of them is extended
    i, j, k = i[ok], j[ok], k[ok]
    order = np.lexsort((i, i - j))
    i, j, k = i[order], j[order], k[order]
    again = np.zeros(len(i), bool)
    again[1:] = (i[1:] - j[1:] == i[:-1] - j[:-1]) & (i[1:] <= i[:-1] + k[:-1]) & (index.item_of[j[1:]] == index.item_of[j[:-1]])
    i, j = i[~again], j[~again]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row = np.searchsorted(bounds, i, "right") - 1
    item = index.item_of[j]
    ib, jb = index.bounds[item], index.bounds[item + 1]
    fore = _extend(letters, bounds[row + 1], index.letters, jb, i, j, 1)
    back = _extend(letters, bounds[row], index.letters, ib, i - 1, j - 1, -1)
    # a start in the item and one in the document name a span; in the order of the document
    order = np.lexsort((j - back, i - back, item, row))
    row, item, d0, q0, n = row[order], item[order], (i - back)[order], (j - back - ib)[order], (fore + back)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (d0[1:] != d0[:-1]) | (q0[1:] != q0[:-1])
    row, item, d0, q0, n = row[new], item[new], d0[new], q0[new], n[new]
    size = whole[item]
    # a stretch ends where no span follows within reach; the item's letters in the spans of each part are counted once
    reach = np.where(letters[d0] >= _WIDE, 3 * k_wide, 3 * k_narrow)
    pair = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    number = np.concatenate([[0], np.cumsum(pair)])
    far = np.maximum.accumulate(d0 + n + number * (len(letters) + 1)) - number * (len(letters) + 1)
    reach = _each(np.maximum, reach, pair)
    part = pair | (d0[1:] > far[:-1] + reach[1:])
    number = np.concatenate([[0], np.cumsum(part)])
    by = np.lexsort((q0, number))
    end = np.maximum.accumulate((q0 + n)[by] + number[by] * (whole.max() + 1)) - number[by] * (whole.max() + 1)
    before = np.concatenate([[0], np.where(part, 0, end[:-1])])
    fresh = np.empty(len(by), np.int64)
    fresh[by] = np.maximum(end - np.maximum(before, q0[by]), 0)
    _, sums = _groups(part)
    enough = sums(fresh) >= density * least_stretch * size
    _, sums = _groups(pair)
    keep = enough & (sums(fresh * enough) >= density * least_cover * size)
    row, item, d0, q0, n, size, reach = (x[keep] for x in (row, item, d0, q0, n, size, reach))
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start, _ = _groups((row[1:] != row[:-1]) | (item[1:] != item[:-1]))
    stop = np.append(start[1:], len(row))
    out_row, out_item, out_share = [], [], []
    for a, z in zip(start.tolist(), stop.tolist()):
        share = _cover(d0[a:z], q0[a:z], n[a:z], int(size[a]), least_stretch, density, int(reach[a]))
        if share >= least_cover:
            out_row.append(row[a])
            out_item.append(item[a])
            out_share.append(share)
    return np.array(out_row, np.int64), index.ids[np.array(out_item, np.int64)], np.array(out_share)


def _cover(d0: np.ndarray, q0: np.ndarray, n: np.ndarray, whole: int, least_stretch: float, density: float, reach: int) -> float:
    """The share of the item in stretches that are long and dense enough; spans are given in the order of the document.

    A span joins the open stretch whose diagonal is nearest, over a gap of at most reach letters on both sides. A stretch is
    closed when no later span can join it.
    """
    open_: list[list[int]] = []  # item start, item end, document end, letters in spans
    done: list[list[int]] = []
    for d, q, m in zip(d0.tolist(), q0.tolist(), n.tolist()):
        still = []
        for c in open_:
            (still if c[2] + reach >= d else done).append(c)
        open_ = still
        best, off = None, 0
        for c in open_:
            gap_d, gap_q = d - c[2], q - c[1]
            if -reach <= gap_q <= reach and q >= c[0] and q + m > c[1] and (best is None or abs(gap_d - gap_q) < off) and abs(gap_d - gap_q) <= reach:
                best, off = c, abs(gap_d - gap_q)
        if best is None:
            open_.append([q, q + m, d + m, m])
        else:
            best[3] += q + m - max(q, best[1])
            best[1], best[2] = q + m, max(best[2], d + m)
    covered = np.zeros(whole, bool)
    for q, e, _, m in done + open_:
        if e - q >= least_stretch * whole and m >= density * (e - q):
            covered[q:e] = True
    return float(covered.sum()) / max(whole, 1)


_INDEXES: dict[str, ItemIndex] = {}


def _index(token: str, sent: Broadcast, *parameters: int) -> ItemIndex:
    """The index of a block of items, built once per worker; only the last block's is kept."""
    if token not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[token] = ItemIndex(*sent.value, *parameters)
    return _INDEXES[token]


def _blocks(items: DataFrame, text: str, block_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items (key, text) in blocks of about block_chars characters, one block at a time on the driver."""
    ids, texts, filled = [], [], 0
    for r in items.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        filled += len(r[1])
        if filled >= block_chars:
            yield ids, texts
            ids, texts, filled = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    k_wide: int = 5, k_narrow: int = 14, window: int = 3, least_stretch: float = 0.2, least_cover: float = 0.5, density: float = 0.6,
    block_chars: int = 8 << 20, slice_bytes: int = 4 << 20,
) -> DataFrame:
    """key, item_key, share: documents that hold at least least_cover of an item in stretches of at least least_stretch.

    Items are fetched in blocks of block_chars characters, so what the driver holds and sends to the executors at once is
    bounded; one pass over the documents is planned per block.
    """
    sized = items.where(F.col(item_key).isNotNull() & (F.length(text) > 0)).select(item_key, text).dropDuplicates([item_key])
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {item_key} long, share double"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(sized, text, block_chars):
        sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, sent, k_wide, k_narrow, window)
            for keys, bodies in slices(batches, slice_bytes):
                row, item, share = leaks(bodies, index, k_wide, k_narrow, window, least_stretch, least_cover, density)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64())], names=[key, item_key, "share"])

        found = found.unionByName(docs.select(key, text).where(F.length(text) > 0).mapInArrow(run, schema))
    return found.groupBy(key, item_key).agg(F.max("share").alias("share"))
