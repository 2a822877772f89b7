"""A trie intersected with the Levenshtein automata of many words at once."""

from __future__ import annotations

import numpy as np

from sagaloom.llm.bpe import IntMap

WILD, MAYBE = 1, 2  # letters of a walk: a masked letter, and one that may be there


class Trie:
    """Terms with their node numbers. A node knows its children, the term that ends in it, and how many errors and masked
    letters a term below it may have."""

    def __init__(self, words: list[tuple[tuple[int, ...], int, int]]):
        goto: dict[int, int] = {}
        ends, errors, room = [-1], [0], [0]
        for n, (word, most, stars) in enumerate(words):
            node = 0
            for c in word:
                key = node << 21 | c
                if key not in goto:
                    goto[key] = len(ends)
                    ends.append(-1)
                    errors.append(0)
                    room.append(0)
                node = goto[key]
                errors[node], room[node] = max(errors[node], most), max(room[node], stars)
            ends[node] = n
        keys = np.fromiter(goto.keys(), np.int64, len(goto))
        to = np.fromiter(goto.values(), np.int64, len(goto))
        self.goto = IntMap(keys, to)
        self.ends, self.errors, self.room = np.array(ends), np.array(errors), np.array(room)
        self.most = np.array([m for _, m, _ in words], np.int64)
        self.stars = np.array([s for _, _, s in words], np.int64)
        self.first = np.zeros(0x110000, bool)
        self.first[keys[keys >> 21 == 0] & 0x1FFFFF] = True
        parent = keys >> 21
        self.child = to[np.argsort(parent, kind="stable")]
        self.child_start = np.searchsorted(np.sort(parent), np.arange(len(ends) + 1))

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, negative where there is none."""
        return self.goto.get(node << 21 | letter.astype(np.int64)).astype(np.int64)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in node and child, for every child."""
        many = self.child_start[node + 1] - self.child_start[node]
        each = np.repeat(np.arange(len(node)), many)
        return each, self.child[np.repeat(self.child_start[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]

    def walk(self, stream: np.ndarray, at: np.ndarray, end: np.ndarray, stems: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Walk from every place at to at most end; number of the walk, where it stopped, term, and number of errors and masked letters of every acceptance.

        With stems the terms are those of words: a term is accepted at the end of the word, a stem anywhere; errors are allowed.
        Without, every term is accepted where it ends, without errors.
        """
        fuzzy = stems is not None
        who = np.flatnonzero(at < end)
        state = [who, at[who], np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)]
        out: list[list[np.ndarray]] = []

        def accept(who: np.ndarray, pos: np.ndarray, node: np.ndarray, err: np.ndarray, used: np.ndarray) -> None:
            term = self.ends[node]
            ok = (term >= 0) & (err <= self.most[term]) & (used <= self.stars[term])
            if fuzzy:
                ok &= (pos == end[who]) | stems[term]
            out.append([who[ok], pos[ok], term[ok], err[ok] + used[ok]])

        while len(state[0]):
            who, pos, node, err, used = state
            new: list[list[np.ndarray]] = []
            inside = pos < end[who]
            c = stream[np.where(inside, pos, 0)]
            star = inside & ((c == WILD) | (c == MAYBE))
            lit = np.flatnonzero(inside & ~star)
            to = self.step(node[lit], c[lit])
            ok = to >= 0
            x = lit[ok]
            new.append([who[x], pos[x] + 1, to[ok], err[x], used[x]])
            if star.any():
                s = np.flatnonzero(star)
                each, down = self.children(node[s])
                s = s[each]
                ok = used[s] < self.room[down]
                s, down = s[ok], down[ok]
                new.append([who[s], pos[s] + 1, down, err[s], used[s] + 1])
                s = np.flatnonzero(star & (c == MAYBE) & (node > 0))
                new.append([who[s], pos[s] + 1, node[s], err[s], used[s]])
            if fuzzy:
                s = np.flatnonzero((node > 0) & (err < self.errors[node]) & ~star)
                each, down = self.children(node[s])
                t = s[each]
                ok = err[t] < self.errors[down]
                t, down = t[ok], down[ok]
                new.append([who[t], pos[t], down, err[t] + 1, used[t]])  # a letter missing
                ok = inside[t]
                new.append([who[t[ok]], pos[t[ok]] + 1, down[ok], err[t[ok]] + 1, used[t[ok]]])  # another letter
                s = s[inside[s]]
                new.append([who[s], pos[s] + 1, node[s], err[s] + 1, used[s]])  # a letter too many
                s = s[pos[s] + 1 < end[who[s]]]
                mid = self.step(node[s], stream[pos[s] + 1])
                s, mid = s[mid >= 0], mid[mid >= 0]
                to = self.step(mid, stream[pos[s]])
                s, to = s[to >= 0], to[to >= 0]
                new.append([who[s], pos[s] + 2, to, err[s] + 1, used[s]])  # two exchanged
            state = [np.concatenate(x) for x in zip(*new)]
            if len(new) > 1 and len(state[0]):  # one state for each place, node and number of stars, with the least errors
                _, one = np.unique(np.stack([state[0], state[1], state[2], state[4], state[3]]), axis=1, return_index=True) if len(state[0]) < 4096 else (None, _distinct(state))
                state = [x[one] for x in state]
            accept(*state)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _distinct(state: list[np.ndarray]) -> np.ndarray:
    key = state[0].astype(np.uint64)
    for x in state[1:]:
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)
    return np.unique(key, return_index=True)[1]
