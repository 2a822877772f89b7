"""Encoding with a public byte-level BPE vocabulary, exactly, in linear time (problem 8).

Text is cut into words by the vocabulary's pattern, here over arrays of code-point classes for a whole batch at once. Each
distinct word is encoded by backtracking: the longest token at every position comes from the vocabulary's trie (the goto
function of an Aho-Corasick automaton, walked from all positions in step), a token is taken if merging could leave it beside
the one before, which the pair check proves from the splits of both tokens, else the next shorter token is tried, else the
last token is given back. Words of a batch advance in step as numpy arrays; words already seen by the worker are looked up.
Decoding gathers bytes by an offset table.

Defined cases: a null text gives null, an empty one an empty list; names of special tokens inside a text are ordinary text;
lone surrogates cannot occur, as Spark strings are UTF-8; rows delivered twice are encoded twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sagaloom.llm.arrow_text import value_bytes

#: Fixed values of the vocabulary's word pattern: what may follow an apostrophe as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


class IntMap:
    """A hash map from non-negative int64 to int32 that looks up whole arrays; missing keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.int64), values.astype(np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point under the pattern: letter, number, white space or other."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m[0]]] = kind
    return out


class Vocabulary:
    """Tables of one byte-level BPE vocabulary whose merge order is the order of its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = 1 + max(vocab[a + b] for a, b in merges)
        n = max(n, 1 + max(vocab[c] for c in letters))
        self.size = n
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        words: list[bytes] = [b""] * n
        for c, b in letters.items():
            words[vocab[c]] = bytes([b])
        #: Priority of a token is its merge's place; pairs that give a token already made by an earlier merge are no merge.
        self.rank = np.zeros(n, np.int64)
        pair_keys, pair_ids = [], []
        for place, (a, b) in enumerate(merges, 1):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if not words[k]:
                words[k] = words[i] + words[j]
                self.left[k], self.right[k], self.rank[k] = i, j, place
            pair_keys.append(i << 32 | j)
            pair_ids.append(k)
        single = sorted(vocab[c] for c in letters)
        if sorted(single + [vocab[a + b] for a, b in merges]) != list(range(n)) or (np.argsort(self.rank, kind="stable")[len(single) :] != np.arange(len(single), n)).any() or single != list(range(len(single))):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        self.pairs = IntMap(np.array(pair_keys), np.array(pair_ids))
        self.lengths = np.array([len(w) for w in words], np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self._grow_trie(words)
        slots = 1 << 20
        self._memo_key, self._memo = np.full(slots, -1, np.int64), np.zeros(slots, bool)
        self.seen: dict[bytes, int] = {}
        self.store, self.filled, self.starts = np.zeros(1 << 16, np.int32), 0, [0]

    def _grow_trie(self, words: list[bytes]) -> None:
        nodes: dict[int, int] = {}
        token = [-1]
        self.prefix = np.full(self.size, -1, np.int32)
        for k in sorted(range(self.size), key=lambda k: words[k]):
            node, best = 0, -1
            for b in words[k]:
                key = node << 8 | b
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                node = nodes[key]
                if token[node] >= 0:
                    best = token[node]
            token[node], self.prefix[k] = k, best
        self.goto = IntMap(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.token = np.array(token, np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE can leave token a directly before token b; answers are kept in a table of recent pairs."""
        key = a.astype(np.int64) << 32 | b
        slot = (((key * 0x9E3779B1) ^ (key >> 29)) & (len(self._memo) - 1)).astype(np.int64)
        out = self._memo[slot]
        new = np.flatnonzero(self._memo_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            said = self._walk((fresh >> 32).astype(np.int64), fresh & 0xFFFFFFFF)[back]
            out[new] = said
            self._memo_key[slot[new]], self._memo[slot[new]] = key[new], said
            twice = self._memo_key[slot[new]] != key[new]  # two new pairs in one slot: its last writer owns it
            if twice.any():
                lost = slot[new][twice]
                self._memo_key[lost] = -1
        return out

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges of both tokens from the latest on; an earlier merge across the border would have parted them."""
        out = np.zeros(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 40, np.int64)
        while len(live):
            merged = self.pairs.get(a << 32 | b)
            ok = ~((merged >= 0) & (merged < limit))
            live, a, b, limit = live[ok], a[ok], b[ok], limit[ok]
            if not len(live):
                break
            first = a > b
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            # the later of both merges is undone; if that one is a byte, the other
            undo_a = np.where(first, ~whole_a, whole_b & ~whole_a)
            done = whole_a & whole_b
            out[live[done]] = True
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a).astype(np.int64), np.where(undo_a, b, self.left[b]).astype(np.int64)
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return out

    def longest(self, data: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The longest token that starts at each position of data, not past its word (room bytes are left of it)."""
        best = np.full(len(data), -1, np.int32)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            node = self.goto.get(node << 8 | data[at + depth]).astype(np.int64)
            ok = node >= 0
            at, node = at[ok], node[ok]
            found = self.token[node]
            best[at[found >= 0]] = found[found >= 0]
            depth += 1
            ok = room[at] > depth
            at, node = at[ok], node[ok]
        return best

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        room = np.repeat(first + size, size) - np.arange(len(data))
        best = self.longest(data, room)
        good = np.ones(len(data) + 1, bool)  # positions from which the rest was not yet found impossible
        stack, depth = np.zeros(len(data), np.int32), np.zeros(len(words), np.int64)
        w, pos, end = np.arange(len(words)), first.copy(), first + size
        tok = best[pos] if len(words) else np.zeros(0, np.int32)
        while len(w):
            to = pos + self.lengths[tok]
            d = depth[w]
            last = stack[np.maximum(first[w] + d - 1, 0)]
            ok = good[to] | (to == end)
            ask = np.flatnonzero(ok & (d > 0))
            ok[ask] = self.compatible(last[ask], tok[ask])
            shorter = self.prefix[tok]
            t = np.flatnonzero(ok)
            stack[first[w[t]] + d[t]] = tok[t]
            depth[w[t]] += 1
            back = np.flatnonzero(~ok & (shorter < 0))
            good[pos[back]] = False
            depth[w[back]] -= 1
            next_pos, next_tok = pos.copy(), np.where(ok, tok, shorter)
            next_pos[t] = to[t]
            going = np.ones(len(w), bool)
            going[t] = to[t] < end[t]
            more = t[going[t]]
            next_tok[more] = best[next_pos[more]]
            next_pos[back] -= self.lengths[last[back]]
            next_tok[back] = last[back]
            # a word that gave its last token back tries that token's next shorter one in the coming step: its end is closed now
            w, pos, tok, end = w[going], next_pos[going], next_tok[going], end[going]
        kept = np.repeat(first, depth) + np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth)
        return stack[kept], depth

    def remember(self, words: list[bytes]) -> None:
        """Encode new words into the store."""
        ids, counts = self.encode_words(words)
        need = self.filled + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(need, len(self.store)), np.int32)])
        self.store[self.filled : need] = ids
        ends = self.filled + np.cumsum(counts)
        self.filled = need
        n = len(self.starts) - 1
        self.seen.update(zip(words, range(n, n + len(words))))
        self.starts.extend(ends.tolist())

    def forget(self, most: int = 12_000_000) -> None:
        """Start the store anew once it holds that many ids or bytes of words, so memory stays bounded."""
        if self.filled > most:
            self.seen, self.filled, self.starts = {}, 0, [0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered by offset."""
        n = self.lengths[ids].astype(np.int64)
        at = np.repeat(self.offsets[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.bytes[at].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, one per worker."""
    return Vocabulary(path)


def word_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in codes where a word of the pattern starts; text_starts are the non-empty texts' first positions."""
    n = len(codes)
    kind = _classes()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[text_starts] = True
    fresh[n] = True
    edge = fresh[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    begin = edge.copy()
    # the last white space before something else goes by itself, or to the next word if it is a plain space
    space = kind == _SPACE
    next_new = np.append(edge[1:], True)
    last = np.flatnonzero(space & next_new & ~fresh[1:])
    begin[last] = True
    joins = last[codes[last] == 32] + 1
    begin[joins] = False
    # an apostrophe by itself at the start of a word takes a contraction's letters
    quote = np.flatnonzero((codes == 39) & begin[:n] & edge & next_new & ~fresh[1:])
    quote = quote[quote + 1 < n]
    for tail in CONTRACTIONS:
        m = len(tail)
        q = quote[quote + m < n]
        same = np.ones(len(q), bool)
        for k, c in enumerate(tail, 1):
            same &= (codes[q + k] == ord(c)) & ~fresh[q + k]
        q = q[same]
        begin[q + 1] = False
        stop = q + 1 + m
        inner = stop[stop < n]
        begin[inner[~edge[inner]]] = True
    return np.flatnonzero(begin)


def _sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, none for null."""
    return np.asarray(pc.binary_length(texts).fill_null(0), np.int64)


def encode_texts(texts: pa.Array, vocab: Vocabulary) -> pa.ListArray:
    """ids of each text of a string array."""
    off = np.concatenate([[0], np.cumsum(_sizes(texts))])
    raw = bytes(value_bytes(texts))
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    firsts = np.searchsorted(byte_at[:-1], off[:-1][off[:-1] < off[1:]])
    begins = byte_at[word_starts(codes, firsts)] if len(codes) else np.zeros(0, np.int64)
    cuts = np.append(begins, len(raw)).tolist()
    vocab.forget()
    words = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    new = [w for w in dict.fromkeys(words) if w not in vocab.seen]
    if new:
        vocab.remember(new)
    which = np.fromiter(map(vocab.seen.__getitem__, words), np.int64, len(words))
    starts = np.array(vocab.starts, np.int64)
    count = starts[which + 1] - starts[which]
    done = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(starts[which] - done[:-1], count) + np.arange(done[-1])
    offsets = done[np.searchsorted(begins, off)]
    ids = pa.array(vocab.store[at])
    mask = np.append(np.asarray(texts.is_null()), False) if texts.null_count else None
    bounds = pa.array(offsets.astype(np.int32), mask=mask)
    return pa.ListArray.from_arrays(bounds, ids)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, slice_bytes: int = 4 << 20) -> DataFrame:
    """key and ids of every row; row by row, without a shuffle. Batches are cut to slice_bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for b in batches:
            texts, n, a = b.column(1), b.num_rows, 0
            size = np.cumsum(_sizes(texts))
            while a < n:
                done = size[a - 1] if a else 0
                z = max(a + 1, int(np.searchsorted(size, done + slice_bytes, "right")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), encode_texts(texts.slice(a, z - a), vocab)], names=[key, "ids"])
                a = z

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_ids(ids: list[int] | np.ndarray, vocabulary_path: str = DEFAULT_VOCABULARY) -> str:
    """The text of ids."""
    return vocabulary(vocabulary_path).decode(np.asarray(ids, np.int64)).decode("utf-8", "replace")
