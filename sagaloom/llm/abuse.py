"""Abusive, hateful and sexually explicit sentences (problem 10).

The lexicon (llm/lexicon.py) holds single words, stems and short expressions by class: insults, violence, vermin, expulsion,
nudity, and so on, and the classes of harmless surroundings. All texts of a batch become one stream of folded letters: case,
width, accents and look-alikes folded, look-alike digits and signs read as letters, stretched letters shortened, invisible
characters dropped. Words spelled out letter by letter (i-d-i-o-t) become one word.

Words are found by intersecting the trie of the lexicon with the Levenshtein automaton of each distinct word of the batch, for all
of them at once: a state is a word, a place in it, a node and a number of errors. Terms of six letters may have one error, of
eleven two; the first letter stays. Masked letters (c*****n) follow every edge, as long as half of the term can be read.
Expressions, and terms in scripts without blanks, are walked from their places in the stream; there a misspelling is one
character replaced by one of the same sound, for terms of two or three characters only after a word like 个 or beside another
term of attack.

A sentence is the context window. Its features are the classes in it and pairs of them (insult and you, group and vermin);
a linear model per category, fitted on reviewed documents from the prior weights below, scores it, and a score above 0 is a
finding. So a word alone stays below, and talk reported, condemned, acted or about rats in a granary is pulled down. A document is
a bag of sentences: in each round the best sentence of a document with a finding stands for it.

Defined cases: null, empty and blank texts have no finding; documents delivered twice give their rows once; a text in a script
without lexicon entries has no finding; without usable labels the prior weights are used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.llm.arrow_text import code_points, slices
from sagaloom.llm.letters import letter_table
from sagaloom.llm.lexicon import LEXICON
from sagaloom.llm.names import sounds
from sagaloom.llm.tries import MAYBE as _MAYBE
from sagaloom.llm.tries import WILD as _WILD
from sagaloom.llm.tries import Trie
from sagaloom.session import cut

CATEGORIES = ("abuse", "hate", "sexual")
CLASSES = (*LEXICON, "INS2", "BAD2", "DIS2", "LOW2", "VER2", "OUT2", "SEX2", "BED2", "QUO")
#: Classes whose terms are found misspelled or masked too.
ATTACKS = ("INS", "BAD", "DIS", "DIE", "HIT", "THR", "SHUT", "PROF", "VER", "LOW", "BASE", "OUT", "SEX", "NUD", "MOA", "BED", "CAR")
#: Signs read as the letters they imitate, characters set in for others, and separators that are letters by class.
SIGNS = {"$": "s", "0": "o", "1": "i", "3": "e", "@": "a", "4": "a", "5": "s", "7": "t", "亖": "死", "勾": "狗", "丨": "", "ـ": ""}
#: Ideographs that name somebody something; before a short term they confirm a misspelling.
NAMING = "个個群帮幫种種是死臭老"
#: Prior weights of classes and of pairs of classes, by category; the fit starts from them and is drawn back to them.
_CALM = {"REP": -3.0, "PLAY": -2.0, "MED": -2.0, "BARN": -0.5, "ART": -1.0, "QUO": -0.4}
PRIOR: dict[str, dict[str, float]] = {
    "abuse": {
        "": -3.0, "PROF": 3.5, "DIE": 3.2, "BAD": 3.1, "BAD2": 1.0, "DIS": 1.7, "DIS2": 1.2, "INS": 1.2, "INS2": 1.0, "HIT": 0.9, "THR": 2.4, "THR YOU": 0.6, "THR BAD": 0.8, "SHUT": 1.5, "YOU": 0.6, "DES": 0.3, "INS YOU": 1.0, "BAD YOU": 1.0,
        "BAD IS": 0.7, "INS IS": 0.4, "BAD INS": 0.8, "BAD SHUT": 0.8, "BAD HIT": 0.8, "HIT YOU": 1.6, "HIT DES": 1.6, "INS SHUT": 1.0, "INS DIS": 1.0, "BAD DIS": 1.0, "INS HIT": 0.8, "DIS YOU": 0.6, "DIS SHUT": 1.0, "SHUT YOU": 0.8, "DIE YOU": 0.6,
        "DIE INS": 1.0, "BAD DIE": 1.0, "GRP": -0.4, "VER GRP": -1.0, "VER OUT": -0.6, "BASE": -0.4, "NUD": -0.6, "INS BARN": -2.0, "VER BARN": -1.0, "BAD BARN": -1.0, **_CALM,
    },
    "hate": {
        "": -3.6, "VER": 1.4, "LOW": 1.2, "BASE": 2.2, "LOW2": 0.8, "VER2": 0.6, "OUT": 1.2, "OUT2": 1.0, "GRP": 0.8, "THEY": 0.4, "ALL": 0.3, "VER GRP": 1.8, "LOW GRP": 1.2, "BASE GRP": 1.4, "BASE MAN": 1.2, "LOW MAN": 0.5, "OUT GRP": 1.6,
        "VER OUT": 1.8, "LOW OUT": 1.4, "BASE OUT": 1.4, "BASE LOW": 1.0, "THEY OUT": 1.0, "THEY VER": 1.0, "THEY LOW": 0.6, "THEY BASE": 1.0, "HIT GRP": 0.9, "ALL LOW": 0.8, "ALL BASE": 0.8, "ALL OUT": 0.6, "DES OUT": 0.8,
        "INS GRP": 0.4, "BAD GRP": 1.2, "YOU": -0.4, "VER BARN": -3.0, "OUT BARN": -1.0, **_CALM,
    },
    "sexual": {
        "": -3.2, "SEX": 3.5, "SEX2": 1.0, "NUD": 1.3, "MOA": 1.2, "BED": 0.8, "BED2": 1.0, "CAR": 1.2, "NUD BED": 1.4, "NUD MOA": 2.0, "MOA BED": 1.4, "CAR BED": 1.6, "CAR NUD": 1.6, "CAR MOA": 1.4, "SEX NUD": 0.8,
        "SEX BED": 0.8, "HIT": -0.6, "LOW": -0.4, "NUD ART": -1.5, "NUD MED": -1.0, **_CALM,
    },
}
_PAIRS = sorted({k for w in PRIOR.values() for k in w if " " in k})
_LONGEST_MASK = 30
_WIDE = 0x2E80


@lru_cache(1)
def _fold() -> np.ndarray:
    """The folded letter of each code point, 0 for what is dropped."""
    return letter_table(SIGNS)


@lru_cache(1)
def _unseen() -> np.ndarray:
    """Code points that break no word: invisible ones and combining marks."""
    out = np.zeros(0x110000, bool)
    for c in [*range(0xA0, 0x3100), *range(0xFE00, 0xFF00), *range(0xE0000, 0xE0200)]:
        out[c] = unicodedata.category(chr(c)) in ("Cf", "Mn", "Me")
    return out


def folded(text: str) -> list[int]:
    """A term's stream of folded letters, a stretched letter of a word once; hyphens part the words of an expression."""
    got: list[int] = []
    for word in text.split("-"):
        first = len(got)
        for c in _fold()[[ord(x) for x in word]].tolist():
            if c and (len(got) == first or got[-1] != c or c >= _WIDE):
                got.append(c)
    return got


def misspelled(term: list[int], alike: dict[str, str]) -> set[tuple[int, ...]]:
    """Spellings of a term of ideographs with one character replaced by one of the same sound."""
    got = {(*term[:i], ord(x), *term[i + 1 :]) for i, c in enumerate(term) for x in alike.get(chr(c), "")}
    return got - {tuple(term)}


class Matcher:
    """The tries of the lexicon: of words, of expressions, and of strings of scripts without blanks with their misspellings."""

    def __init__(self, lexicon: dict[str, str] | None = None, alike: dict[str, str] | None = None, ordinary: Iterable[str] = ()):
        self.ordinary = frozenset(ordinary)
        words: dict[tuple[int, ...], dict[int, bool]] = {}
        runs: dict[tuple[int, ...], set[int]] = {}
        for n, group in enumerate((lexicon or LEXICON).values()):
            for entry in group.split():
                t = tuple(folded(entry))
                if t[0] < _WIDE and "-" not in entry:
                    both = words.setdefault(t, {})
                    both[n] = both.get(n, False) or entry.endswith("*")
                else:
                    runs.setdefault(t, set()).add(n)
        listed, uses = [], []
        for t, kinds in words.items():
            most = (len(t) >= 6) + (len(t) >= 11)
            listed.append((t, most, len(t) - max(2, (len(t) + 1) // 2) if len(t) > 2 else 0))
            uses.append(kinds)
        self.words = Trie(listed)
        self.word_stem = np.array([any(k.values()) for k in uses])
        # a spelling may be a stem in one class and a whole word in another
        self.word_class = _ragged([[(n, int(stem)) for n, stem in k.items()] for k in uses])
        self.runs = Trie([(t, 0, len(t) - max(2, (len(t) + 1) // 2) if len(t) > 2 else 0) for t in runs])
        self.run_wide = np.array([t[0] >= _WIDE for t in runs])
        self.run_class = _ragged([[(n, 0) for n in sorted(k)] for k in runs.values()])
        exact, short = set(runs), {}
        for n, t in enumerate(runs):
            if t[0] >= _WIDE and 2 <= len(t) <= 6:
                for v in sorted(misspelled(list(t), alike or {})):
                    if v not in exact:
                        short.setdefault(v, n)
        self.variants = Trie([(v, 0, 0) for v in short])
        self.variant_of = np.array(list(short.values()), np.int64)
        self.variant_size = np.array([len(v) for v in short], np.int64)
        self.attack = np.isin(list(lexicon or LEXICON), ATTACKS)
        self.misread = np.array([bool(k & {CLASSES.index(x) for x in ("INS", "BAD", "DIE", "PROF", "DIS", "THR", "VER")}) for k in runs.values()])

    def classes(self, stream: np.ndarray, sentence: np.ndarray, word: np.ndarray, letter: np.ndarray, near: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentence, class and term of everything found in a stream of letters; word numbers its words, letter
        tells letters from signs read as such, and a word of signs only (a number) is none.

        Words read as misspellings are left out where they are ordinary; near, if given, takes (sentence, word) of those read.
        """
        n = len(stream)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        new = np.ones(n, bool)
        new[1:] = (word[1:] != word[:-1]) | (sentence[1:] != sentence[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], n)
        # spelled-out words: three or more single letters in a row
        single = (stop - start == 1) & (stream[start] < _WIDE)
        row = np.ones(len(start), bool)
        row[1:] = ~(single[1:] & single[:-1] & (sentence[start[1:]] == sentence[start[:-1]]))
        run = np.cumsum(row) - 1
        many = np.bincount(run)[run]
        start, stop = start[row | (many < 3)], stop[np.append(row[1:], True) | (many < 3)]
        letters = np.append(0, np.cumsum(letter))
        ok = letters[stop] > letters[start]
        start, stop = start[ok], stop[ok]
        # distinct words, by a rolling hash
        values = stream.astype(np.uint64) + np.uint64(0x1F3)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:n], dtype=np.uint64)])
        key = (sums[stop] - sums[start]) * power[n - start] ^ (stop - start).astype(np.uint64)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        plain = self.words.first[stream[start[one]]] | (stream[start[one]] <= _MAYBE)
        pick = np.flatnonzero(plain)
        who, pos, term, err = self.words.walk(stream, start[one][pick], stop[one][pick], self.word_stem)
        which = pick[who]
        ended = pos == stop[one][which]
        best = np.full(len(one), 9)
        np.minimum.at(best, which, err)
        ok = err == best[which]  # a word that stands in the lexicon is no misspelling of another
        wrong = np.unique(which[ok & (err > 0)])
        spelled = _strings(stream, start[one[wrong]], stop[one[wrong]])
        usual = np.array([w in self.ordinary for w in spelled], bool)
        ok &= ~np.isin(which, wrong[usual])
        if near is not None:
            name = dict(zip(wrong.tolist(), spelled))
            near += [(sentence[start[i]], name[back[i]]) for i in np.flatnonzero(np.isin(back, wrong))]
        which, term, ended, err = which[ok], term[ok], ended[ok], err[ok]
        each, cls, stem = _spread(self.word_class, term)
        ok = ended[each] | (stem > 0)
        ok &= (err[each] == 0) | self.attack[cls]
        which, cls, term = which[each][ok], cls[ok], term[each][ok]
        by = np.argsort(which, kind="stable")
        which, cls, term = which[by], cls[by], term[by]
        lo, hi = np.searchsorted(which, back, "left"), np.searchsorted(which, back, "right")
        times = hi - lo
        pick = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found = [(np.repeat(sentence[start], times), cls[pick], term[pick])]
        # expressions begin and end with a word, strings of ideographs anywhere
        begins = np.zeros(n, bool)
        begins[start] = True
        ends = np.zeros(n + 1, bool)
        ends[stop] = True
        limit = np.append(np.flatnonzero(np.diff(sentence)) + 1, n)
        limit = limit[np.searchsorted(limit, np.arange(n), "right")]
        at = np.flatnonzero((self.runs.first[stream] & (begins | (stream >= _WIDE))) | (begins & (stream <= _MAYBE)))
        at = np.concatenate([at, np.flatnonzero((stream == _WILD) & ~begins & (np.append(stream[1:], 0) >= _WIDE))])
        who, pos, term, _ = self.runs.walk(stream, at, limit[at])
        ok = self.run_wide[term] | (begins[at[who]] & ends[pos])
        who, term = who[ok], term[ok]
        found.append(self._named(sentence[at[who]], term))
        if len(self.variant_of):
            at = np.flatnonzero(self.variants.first[stream])
            who, pos, v, _ = self.variants.walk(stream, at, limit[at])
            at, term, size = at[who], self.variant_of[v], self.variant_size[v]
            before = np.maximum(at - 1, 0)
            named = np.isin(stream[before], _NAMING) & (at > 0) & (sentence[before] == sentence[at])
            attacked = np.unique(found[1][0][np.isin(found[1][1], np.flatnonzero(self.attack))])
            ok = self.misread[term] & ((size > 3) | named | np.isin(sentence[at], attacked))
            spelled = _strings(stream, at, at + size)
            ok &= ~np.array([w in self.ordinary for w in spelled], bool)
            if near is not None:
                near += [(sentence[at[i]], spelled[i]) for i in np.flatnonzero(ok)]
            found.append(self._named(sentence[at[ok]], term[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _named(self, sent: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each, cls, _ = _spread(self.run_class, term)
        return sent[each], cls, term[each] + len(self.word_stem)

    def features(self, texts: pa.Array, near: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row and features (bits of CLASSES) of every sentence of an Arrow string array in which anything is found.

        near, if given, takes (row, word) of the words read as misspellings.
        """
        codes, lengths = code_points(texts)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fold = _fold()[codes]
        stop = np.isin(codes, _STOPS)
        dot = np.flatnonzero(codes == 46)  # a full stop before a space, but not the dots of a spelled-out word
        after = codes[np.minimum(dot + 1, len(codes) - 1)]
        stop[dot[(after == 32) & ((dot < 2) | (codes[np.maximum(dot - 2, 0)] != 46))]] = True
        row_start = np.cumsum(lengths)[:-1]
        starts = np.zeros(len(codes), np.int64)
        starts[1:] = stop[:-1]
        starts[row_start[row_start < len(codes)]] = 1
        sentence = np.cumsum(starts)
        mask, maybe = _masked(codes, fold, starts)
        fold[mask], fold[maybe] = _WILD, _MAYBE
        kept = np.flatnonzero(fold)
        breaks = np.cumsum(((fold == 0) & ~_unseen()[codes]) | (starts > 0))
        stream, place, word = fold[kept], sentence[kept], breaks[kept]
        keep = np.ones(len(stream), bool)
        keep[1:] = (stream[1:] != stream[:-1]) | (place[1:] != place[:-1]) | (stream[1:] <= _MAYBE) | (stream[1:] >= _WIDE)
        keep[1:] |= (word[1:] != word[:-1]) & (stream[1:] < _WIDE) & (np.append(word[2:], -1) == word[1:])  # a new word, but for single letters
        stream, place, word, kept = stream[keep], place[keep], word[keep], kept[keep]
        letter = (stream > _MAYBE) & ~np.isin(codes[kept], _SIGNS)
        row_of = np.repeat(np.arange(len(texts)), lengths)
        read: list = [] if near is not None else None
        sent, cls, term = self.classes(stream, place, word, letter, read)
        if near is not None:
            near += [(int(row_of[np.searchsorted(sentence, t)]), w) for t, w in read]
        if not len(sent):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # distinct terms of a class in a sentence
        key = np.unique((sent << 26 | cls << 20) | term) if len(self.word_stem) + len(self.run_wide) < 1 << 20 else None
        sent, cls = key >> 26, key >> 20 & 63
        every, back = np.unique(sent, return_inverse=True)
        count = np.zeros((len(every), len(LEXICON)), np.int64)
        np.add.at(count, (back, cls), 1)
        bits = ((count > 0) << np.arange(len(LEXICON))).sum(1)
        for name in CLASSES[len(LEXICON) : -1]:
            bits |= (count[:, CLASSES.index(name[:-1])] > 1).astype(np.int64) << CLASSES.index(name)
        quote = np.flatnonzero(np.isin(codes, _QUOTES))
        before = np.searchsorted(kept, quote)  # letters of the same sentence on both sides
        ok = (before > 0) & (before < len(kept))
        q, b = quote[ok], before[ok]
        ok = (place[b - 1] == sentence[q]) & (place[b] == sentence[q])
        bits |= np.isin(every, sentence[q[ok]]).astype(np.int64) << CLASSES.index("QUO")
        return row_of[np.searchsorted(sentence, every)], bits


def _strings(stream: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[str]:
    return ["".join(map(chr, stream[a:z].tolist())) for a, z in zip(start.tolist(), stop.tolist())]


def _ragged(lists: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = [x for one in lists for x in one]
    return np.cumsum([0, *map(len, lists)]), np.array([a for a, _ in flat], np.int64), np.array([b for _, b in flat], np.int64)


def _spread(table: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position in which, and both values, for each entry of the lists that which names."""
    first, a, b = table
    many = first[which + 1] - first[which]
    each = np.repeat(np.arange(len(which)), many)
    at = np.repeat(first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return each, a[at], b[at]


_STOPS = np.array([ord(c) for c in "。！？!?\n｡।"], np.uint32)
_QUOTES = np.array([ord(c) for c in "\"“”„«»「」『』‘"], np.uint32)
_SIGNS = np.array([ord(c) for c, x in SIGNS.items() if x.isascii()], np.uint32)
_NAMING = np.array([ord(c) for c in NAMING], np.uint32)


def _masked(codes: np.ndarray, fold: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of stars that mask letters: runs of two or more between letters, and those that may: single ones between
    letters, longer runs with a letter at one side."""
    star = np.flatnonzero(codes == 42)
    if not len(star):
        return star, star
    new = np.append(True, np.diff(star) > 1)
    run = np.cumsum(new) - 1
    first, last = star[new], star[np.append(new[1:], True)]
    length = last - first + 1
    left = (first > 0) & (starts[first] == 0) & (fold[np.maximum(first - 1, 0)] > 0)
    after = np.minimum(last + 1, len(codes) - 1)
    right = (last < len(codes) - 1) & (starts[after] == 0) & (fold[after] > 0)
    fits = length <= _LONGEST_MASK
    wild = fits & left & right & (length > 1)
    maybe = fits & np.where(length > 1, left ^ right, left & right)
    return star[wild[run]], star[maybe[run]]


def same_sound(spark: SparkSession) -> dict[str, str]:
    """The ideographs of the same sound as each one in the lexicon."""
    sound = sounds(spark)
    by: dict[str, list[str]] = {}
    for c, x in sound.items():
        by.setdefault(x, []).append(c)
    need = {c for group in LEXICON.values() for c in group if c in sound}
    return {c: "".join(x for x in by[sound[c]] if x != c) for c in sorted(need)}


@dataclass(frozen=True)
class Model:
    """Weights of the features by category, and ordinary words that are near a term of the lexicon without meaning it."""

    weights: np.ndarray = field(default_factory=lambda: prior())
    ordinary: tuple[str, ...] = ()


@lru_cache(2)
def matcher(alike: tuple[tuple[str, str], ...] = (), ordinary: tuple[str, ...] = ()) -> Matcher:
    """The matcher of the lexicon, one per worker."""
    return Matcher(LEXICON, dict(alike), ordinary)


def design(bits: np.ndarray) -> np.ndarray:
    """The model's columns: one, the classes, the pairs of classes."""
    one = (bits[:, None] >> np.arange(len(CLASSES)) & 1).astype(np.float64)
    at = {c: i for i, c in enumerate(CLASSES)}
    pairs = [one[:, at[p.split()[0]]] * one[:, at[p.split()[1]]] for p in _PAIRS]
    return np.column_stack([np.ones(len(bits)), one, *pairs])


def prior() -> np.ndarray:
    """The prior weights, a row per category."""
    names = ["", *CLASSES, *_PAIRS]
    return np.array([[PRIOR[c].get(n, 0.0) for n in names] for c in CATEGORIES])


def fit(doc: np.ndarray, bits: np.ndarray, verdicts: dict[int, set[str]], pull: float = 0.4, rounds: int = 4, favour: float = 20.0) -> np.ndarray:
    """Weights from sentences (document number, features) and the verdicts of the documents.

    Of a document with a finding of a category the best sentence is its positive example, in each round anew; all sentences of
    documents reviewed as clean are negative ones. Logistic loss; favour is the weight of a positive
    example, as they are few, and pull, for each positive example, draws the weights to the prior ones, alike at every size.
    """
    weights, x = prior(), design(bits)
    clean = np.isin(doc, [d for d, v in verdicts.items() if v == {"clean"}])
    for k, category in enumerate(CATEGORIES):
        # a document with a finding holds harmless sentences too, so only its best one is used
        has = np.isin(doc, [d for d, v in verdicts.items() if category in v])
        if not has.any() or not clean.any():
            continue
        for _ in range(rounds):
            score = x @ weights[k]
            order = np.lexsort((-score, doc))
            best = order[np.append(True, np.diff(doc[order]) != 0)]
            best = best[has[best] & (score[best] > -2.5)]  # a wrong verdict has no sentence that could stand for it
            if not len(best):
                break
            rows = np.concatenate([best, np.flatnonzero(clean)])
            y = np.concatenate([np.ones(len(best)), np.zeros(clean.sum())])
            w, a, weight = prior()[k].copy(), x[rows], np.where(y > 0, favour, 1.0)
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                grad = a.T @ (weight * (p - y)) + pull * len(best) * (w - prior()[k])
                hess = (a * (weight * p * (1 - p))[:, None]).T @ a + pull * len(best) * np.eye(len(w))
                w = w - np.linalg.solve(hess, grad)
            weights[k] = w
    return weights


def ordinary_words(near: Iterable[tuple[int, str]], verdicts: dict[int, set[str]]) -> tuple[str, ...]:
    """Of (document, word read as a misspelling), the words in clean documents that are not more often in those with findings."""
    balance: dict[str, int] = {}
    for doc, word in set(near):
        clean = verdicts.get(doc) == {"clean"}
        balance[word] = balance.get(word, 0) + (1 if clean else -1)
    usual = {word for doc, word in near if verdicts.get(doc) == {"clean"}}
    return tuple(sorted(w for w in usual if balance[w] >= 0))


def fit_reviewed(docs: DataFrame, labels: DataFrame, sample: int = 20_000, key: str = "doc_id", text: str = "text", slice_bytes: int = 2 << 20) -> Model:
    """A model fitted on at most sample reviewed documents (those with the least hash of their key; the bound is this parameter).

    Only keys, verdicts, distinct features of sentences and words that look misspelled reach the driver.
    """
    verdict = F.lower(F.trim("verdict"))
    known = labels.where(F.col(key).isNotNull() & verdict.isin("clean", *CATEGORIES)).groupBy(key).agg(F.collect_set(verdict).alias("v"))
    known = known.orderBy(F.xxhash64(key), key).limit(sample).collect()
    if not known:
        return Model()
    kind = docs.schema[key].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(r[0],) for r in known], f"{key} {kind}")
    few = cut(docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(wanted), key, "left_semi").dropDuplicates([key]))
    alike = tuple(same_sound(docs.sparkSession).items())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(alike)
        for keys, texts in slices(batches, slice_bytes):
            near: list = []
            m.features(texts, near)
            row, word = [r for r, _ in near], [w for _, w in near]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(word, pa.string())], names=[key, "word"])

    number = {r[0]: n for n, r in enumerate(known)}
    verdicts = {n: set(r[1]) for n, r in enumerate(known)}
    near = few.mapInArrow(words, f"{key} {kind}, word string").distinct().collect()
    ordinary = ordinary_words([(number[r[0]], r[1]) for r in near], verdicts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(alike, ordinary)
        for keys, texts in slices(batches, slice_bytes):
            row, bits = m.features(texts)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(bits, pa.int64())], names=[key, "bits"])

    got = few.mapInArrow(rows, f"{key} {kind}, bits long").distinct().collect()
    doc, bits = np.array([number[r[0]] for r in got], np.int64), np.array([r[1] for r in got], np.int64)
    return Model(fit(doc, bits, verdicts) if len(doc) else prior(), ordinary)


def flag_documents(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.0, slice_bytes: int = 2 << 20) -> DataFrame:
    """key, category, score: findings per document and category, with the score of its worst sentence; no text is shuffled."""
    model = model or Model()
    alike = tuple(same_sound(docs.sparkSession).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(alike, model.ordinary)
        for keys, texts in slices(batches, slice_bytes):
            row, bits = m.features(texts)
            each, back = np.unique(bits, return_inverse=True)
            score = (design(each) @ model.weights.T)[back]
            s, c = np.nonzero(score > threshold)
            names = pa.array(CATEGORIES).take(pa.array(c, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[s], pa.int64())), names, pa.array(score[s, c], pa.float64())], names=[key, "category", "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, category string, score double")
    return found.groupBy(key, "category").agg(F.max("score").alias("score"))


def rates_by_source(docs: DataFrame, found: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """source, category, n_docs, n_found, rate: how many of a source's distinct documents have a finding."""
    each = docs.groupBy(key).agg(F.min(source).alias(source))
    flags = found.groupBy(key).pivot("category", list(CATEGORIES)).agg(F.lit(1))
    counted = each.join(flags, key, "left").groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), *(F.count(c).alias(c) for c in CATEGORIES))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n_found")) for c in CATEGORIES)))
    return counted.select(source, "n_docs", rows.alias("r")).select(source, "r.category", "n_docs", "r.n_found", (F.col("r.n_found") / F.col("n_docs")).alias("rate"))
