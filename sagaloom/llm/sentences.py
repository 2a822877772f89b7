"""Sentence boundaries across languages and scripts (problem 1).

Characters are tagged boundary or inside by linear-chain conditional random fields and Viterbi decoding; the fit is by
forward-backward over whole chains. The first field runs over the places that marks give: ends of mark runs, spaces of Thai and
blank lines can be boundaries, all other characters are inside for certain. A place is described by its marks, the quotation or
title it stands in, the words around it and the clause after it.

Weights start from a prior that holds general knowledge (marks, common abbreviations, speech after a quotation) and are fitted
to the corpus itself: of a bounded sample of chunks, those whose stored elements end at most of the undoubted marks serve as
weak labels, unless they also end where the prior is certain that none does (a tool that cuts at every dot). A corpus without
usable chunks leaves the prior.

The second field is for stretches without any mark or space, in scripts that need none between words: ideographs and kana, Thai,
Lao, Khmer, Burmese. There every gap between characters is a place, described by the characters around it. It is trained on
text whose marks were stripped: the sentences that the first field finds in the same sample, run together without their marks
and spaces. It decodes stretches longer than twice the mean sentence it was trained on; a script not seen in training has no
boundaries inside a stretch. It is asked for (fit_bare): where the rule is that only marks end a sentence, it is left out.

Defined cases: a null array gives no rows, null elements count as empty, a text of white space gives no rows; a text without
any boundary is one sentence; rows delivered twice give their sentences once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end sentences, by kind.
STRONG = "。！？!?؟।॥｡︒︕︖‼⁇⁈⁉۔።᙮꓿"
DOTS = ".．"
#: Quotation marks and brackets; those that open by position or language are listed with what closes them.
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "«": "»", "„": "“”", "‚": "‘’", "｢": "｣", "〝": "〞"}
TITLES = "《〈"
BRACKETS = "（([【"
_SURE_CLOSERS = set("”’」』》〉）)】»｣")
CLOSERS = set("".join(PAIRS.values())) | {'"'}
#: Abbreviations after which a sentence mostly goes on, without their last dot, in small letters.
ABBREVIATIONS = set(
    "mr mrs ms dr prof capt lt col gen sgt st rev hon jr sr vs etc e.g i.e cf fig no vol ch p pp al approx a.m p.m a p inc ltd co "
    "z b bzw ca vgl s u d h usw nr bd kap str hr fr ing "
    "m mm mme mlle me p.ex ex chap av boul éd env n° "
    "sra srta dra ud uds ee uu pág págs núm cap aprox n m "
    "ул г гг т д е н э стр рис им проф др п тыс руб напр см "
    "डॉ नं श्री प्रो पृ "
    "د أ م ص ج".split()
)
#: Those of them that may well end a sentence, and names of months, which go on a number with a dot.
MAY_END = {"etc", "usw", "jr", "inc", "ltd", "co", "approx", "al"}
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Words that say that someone speaks.
SPEECH = re.compile(
    r"[问問道说說喊叫答嚷骂嘀]|开口|冷笑|低语|自语|回应|尋ね|言[いうっ]|叫[びん]|答え|つぶや|कहा|पूछा|बोला|चिल्ला|"
    r"\b(?:said|says|asked|cried|shouted|whispered|replied|answered|muttered|murmured|called|sagte|fragte|rief|flüsterte|antwortete|"
    r"dit|demanda|répondit|cria|murmura|preguntó|gritó|respondió|dijo|murmuró|спросил|сказал|крикнул|ответил|прошептал)|قال|سأل|صاح"
)
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_EVENT = re.compile(
    rf"\n[^\S\n]*\n\s*|(?<=[ก-๏0-9])[    　]+(?=[ก-๏])|[{STRONG}{DOTS}…⋯]+(?:[{_INVISIBLE}]*[{STRONG}{DOTS}…⋯])*|[" + re.escape("".join(PAIRS) + "".join(sorted(CLOSERS))) + "]"
)
_WORD_BEFORE = re.compile(r"[^\s,;:!?…“”\"«»„()\[\]।「」『』《》，。！？；：—]*$")
_WORD_AFTER = re.compile(r"[\w]+")
_CLAUSE = re.compile(r"[^，,。．.！？!?；;：:\n“”„«»「」『』\"।؟]*[，,。．.！？!?；;：:\n“”„«»「」『』\"।؟]?")
_SKIP = re.compile(rf"[\s{_INVISIBLE}]*")


def _shape(c: str) -> str:
    """What sort of character a sentence would begin with."""
    if not c:
        return "end"
    if c == "\n":
        return "newline"
    cat = unicodedata.category(c)
    if cat == "Lu":
        return "upper"
    if cat == "Ll":
        return "lower"
    if cat[0] == "N":
        return "digit"
    if cat == "Pd":
        return "dash"
    if c in PAIRS or c == '"' or c in "¿¡—":
        return "open"
    if cat[0] in "LM":
        return "script"
    return "mark"


def places(text: str) -> list[tuple[int, bool, list[str]]]:
    """(end, certain, description) of every place that can be a boundary; certain ones are boundaries."""
    out: list[tuple[int, bool, list[str]]] = []
    stack: list[list] = []  # open quotations: opening mark, what stood before it, ends inside
    sentence, skip_to, n = 0, 0, len(text)
    for m in _EVENT.finditer(text):
        a, z = m.span()
        if a < skip_to:
            continue
        s = m[0]
        if s[0] == "\n":
            out.append((a, True, []))
            sentence, stack = z, []
            continue
        if s[0] in "    　":
            out.append((z, False, ["thai", "thai:" + ("digit" if text[a - 1].isdigit() else "letter")]))
            sentence = z
            continue
        if len(s) == 1 and (s in PAIRS or s in CLOSERS):
            if stack and s in (PAIRS.get(stack[-1][0]) or stack[-1][0]):
                stack.pop()
            elif s in PAIRS or s == '"':
                before = text[sentence:a].rstrip()
                lead = "start" if not before else "colon" if before[-1] in ":：," or (before[-1] in "，" and SPEECH.search(before[-4:])) else "text"
                stack.append([s, lead, 0])
            continue
        # a run of marks: take closing marks, and marks after them, into its end
        depth, closed, end, tail = len(stack), [], z, s
        while True:
            k = _SKIP.match(text, end).end()
            c = text[k] if k < n else ""
            near = k == end or (c == "»" and k - end <= 2) or all(x in _INVISIBLE for x in text[end:k])
            if c and near and stack and c in (PAIRS.get(stack[-1][0]) or stack[-1][0]):
                closed.append(stack.pop())
                end = k + 1
            elif c and near and not stack and c in _SURE_CLOSERS:  # its opening was cut off
                closed.append([c, "lost", 0])
                end = k + 1
            elif c and k == end and closed and (c in STRONG or c in DOTS):
                end += 1
            else:
                break
        skip_to = end
        k = _SKIP.match(text, end).end()
        after = text[k] if k < n else ""
        marks = unicodedata.normalize("NFKC", "".join(c for c in s if c not in _INVISIBLE))
        dot = marks == "."
        if not closed and dot and k == end and after and (after.isalnum() or after in "-_/@") and not "⺀" <= after <= "ꀀ":
            if not (after.isupper() and a > 1 and text[a - 1].islower() and text[a - 2].islower()):
                continue  # within a number, a name or an address
        d = ["strong" if not set(marks) <= {".", "…", "⋯"} else "dot" if dot else "dots"]
        shape = _shape(after)
        gap = "gap" if k > end else "tight"
        d += ["next:" + shape, f"{d[0]}/{shape}", f"{d[0]}/{gap}"]
        if marks[-1:] in "…⋯" and d[0] == "strong":
            d.append("dots")
        if dot or d[0] == "dots":
            word = _WORD_BEFORE.search(text, max(sentence, a - 16), a)[0].lower()
            word = re.sub(rf"[{_INVISIBLE}]", "", re.sub(r"\d+", "#", word))
            d += ["word:" + word[-9:] + "/" + shape, "word:" + word[-9:]]
            if word in ABBREVIATIONS:
                d.append("abbreviation")
                if word in MAY_END and shape in ("upper", "open"):
                    d.append("abbreviation may end")
            if len(word) == 1 and word.isalpha():
                d.append("initial")
            if word.endswith("#"):
                d.append("number/" + shape)
                if dot and not text[sentence:a].strip().strip("0123456789"):
                    d.append("number alone")
            if dot and (w := _WORD_AFTER.match(text, k)):
                d.append("before:" + w[0].lower()[:10])
                if word.endswith("#") and w[0].lower() in MONTHS:
                    d.append("number before month")
        if closed:
            mark, lead, ends = closed[0]
            kind = "title" if mark in TITLES + "》〉" else "bracket" if mark in BRACKETS + "）)】" else "quote"
            d += ["closed:" + kind, f"closed:{kind}/{d[0]}/{shape}"]
            if kind == "quote":
                clause = _CLAUSE.match(text, k)[0]
                last = clause[-1:]
                opens = text[k + len(clause) : k + len(clause) + 2].strip()[:1]
                says = bool(SPEECH.search(clause)) and last not in ":：" and last not in "“„«「『\"" and not (last in ",，" and opens and opens in PAIRS)
                d += [f"lead:{lead}", f"lead:{lead}/{'says' if says else 'on'}", f"lead:{lead}/{shape}", f"lead:{lead}/{'many' if ends else 'one'}"]
                if after == "と" or after == "っ":
                    d.append("quoted")
                if shape == "script":
                    d += ["clause:" + clause[-3:], "first:" + clause[:2]]
        elif stack:
            inner = stack[-1]
            kind = "title" if inner[0] in TITLES else "bracket" if inner[0] in BRACKETS else "quote"
            d += ["in:" + kind, f"in:{kind}/{d[0]}/{shape}"]
            if d[0] == "strong" or (dot and shape in ("upper", "open", "script")):
                inner[2] += 1
        if depth > len(closed) and closed:
            d.append("nested")
        out.append((end, False, d))
        if d[0] != "dots" and not closed and not stack:
            sentence = end
        elif closed and not stack and shape not in ("lower", "dash", "mark"):
            sentence = end if "lead:text" not in d else sentence
    return out


#: Weights of the prior, by description; what is not listed starts at nothing.
PRIOR = {
    "strong": 3.0, "dot": 2.5, "dots": -4.0, "thai": 3.0,
    "next:lower": -5.0, "next:mark": -5.0, "next:dash": -4.0, "next:end": 6.0,
    "abbreviation": -4.5, "abbreviation may end": 5.0, "initial": -4.0, "number/lower": -1.0, "number before month": -6.0, "number alone": -6.0,
    "closed:title": -6.0, "closed:bracket": 0.0, "in:title": -7.0, "in:bracket": -5.0, "quoted": -6.0,
    "lead:text": -6.0, "lead:start/says": -6.0, "lead:lost/says": -4.0, "lead:colon/says": 0.0,
    "dots/end": 4.0, "dot/tight": -0.5,
}


def marginals(score: np.ndarray, length: np.ndarray, after: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Of padded chains: the probability of a boundary at each place, and the expected number of boundaries after an inside and
    after a boundary. A boundary at a place scores score + after[label before]; the place before the first is a boundary."""
    n, most = score.shape
    live = np.arange(most) < length[:, None]
    with np.errstate(over="ignore"):
        fore = np.zeros((most + 1, n, 2))
        fore[0] = [-1e30, 0.0]
        for t in range(most):
            inside = np.logaddexp(fore[t, :, 0], fore[t, :, 1])
            bound = np.logaddexp(fore[t, :, 0] + after[0], fore[t, :, 1] + after[1]) + score[:, t]
            fore[t + 1] = np.where(live[:, t, None], np.stack([inside, bound], 1), fore[t])
        back = np.zeros((n, 2))
        total = np.logaddexp(fore[most, :, 0], fore[most, :, 1])
        p, pairs = np.zeros((n, most)), np.zeros(2)
        for t in range(most - 1, -1, -1):
            on = live[:, t]
            each = np.stack([np.exp(np.minimum(fore[t, :, y] + after[y] + score[:, t] + back[:, 1] - total, 0.0)) * on for y in (0, 1)])
            p[:, t] = each.sum(0)
            pairs += each.sum(1)
            new = np.stack([np.logaddexp(back[:, 0], after[y] + score[:, t] + back[:, 1]) for y in (0, 1)], 1)
            back = np.where(on[:, None], new, back)
    return p, pairs


def decode(score: list[float], after: tuple[float, float]) -> list[int]:
    """Positions of the boundaries of the best labelling of a chain, by Viterbi."""
    best, back = (-1e9, 0.0), []
    for s in score:
        bound = (best[0] + s + after[0], best[1] + s + after[1])
        back.append((int(best[1] >= best[0]), int(bound[1] >= bound[0])))
        best = (max(best), max(bound))
    label, out = int(best[1] >= best[0]), []
    for t in range(len(score) - 1, -1, -1):
        if label:
            out.append(t)
        label = back[t][label]
    return out[::-1]


def fit_field(rows: list[list[list[str]]], labels: list[list[int]], fixed: list[list[bool]], start: dict[str, float], rounds: int, rate: float, pull: float) -> dict[str, float]:
    """Weights of a field with boundary scores linear in descriptions, from labelled chains; fixed places are boundaries for
    certain. Steps along the gradient of the likelihood (expected minus observed counts), drawn to the start by pull."""
    names = sorted({x for chain in rows for d in chain for x in d})
    index = {x: i for i, x in enumerate(names)}
    length = np.array([len(c) for c in rows])
    most = int(length.max())
    cell = np.array([c * most + t for c, chain in enumerate(rows) for t, d in enumerate(chain) for _ in d], np.int64)
    which = np.array([index[x] for chain in rows for d in chain for x in d], np.int64)
    y, sure = np.zeros((len(rows), most)), np.zeros((len(rows), most), bool)
    for c, (lab, fix) in enumerate(zip(labels, fixed)):
        y[c, : len(lab)], sure[c, : len(fix)] = lab, fix
    before = np.concatenate([np.ones((len(rows), 1)), y[:, :-1]], 1)
    saw = np.array([((before == v) & (y == 1)).sum() for v in (0, 1)], float)
    w0 = np.array([start.get(x, 0.0) for x in names])
    a0 = np.array([start.get("after:0", 0.0), start.get("after:1", 0.0)])
    w, a, seen = w0.copy(), a0.copy(), np.bincount(which, minlength=len(names))
    speed, turn = np.full(len(names), 1e-3), np.full(2, 1e-3)
    for _ in range(rounds):
        score = np.bincount(cell, w[which], len(rows) * most).reshape(len(rows), most)
        p, pairs = marginals(np.where(sure, 50.0, np.clip(score, -30, 30)), length, (a[0], a[1]))
        off = np.where(sure, 0.0, p - y)
        g = np.bincount(which, off.ravel()[cell], len(names)) + pull * (w - w0)
        speed += (g / np.maximum(seen, 1)) ** 2
        w -= rate * (g / np.maximum(seen, 1)) / np.sqrt(speed)
        ga = (pairs - saw) / max(1.0, y.sum()) + 0.01 * (a - a0)
        turn += ga**2
        a -= 0.2 * rate * ga / np.sqrt(turn)
    return {**{x: float(v) for x, v in zip(names, w)}, "after:0": float(a[0]), "after:1": float(a[1])}


#: Scripts that put no spaces between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_STRETCH = re.compile(f"[{_UNSPACED}]{{12,}}")


def gaps(run: str) -> list[list[str]]:
    """The description of every gap between the characters of a run without marks."""
    out = []
    for i in range(1, len(run)):
        a, b = run[i - 1], run[i]
        out.append(["l" + a, "r" + b, "L" + run[max(0, i - 2) : i], "R" + run[i : i + 2], "x" + a + b])
    return out


class Tagger:
    """Weights of both fields by description, with the prior as the centre of the first, and decoding."""

    def __init__(self, weights: dict[str, float] | None = None, bare: dict[str, float] | None = None, least: int = 1 << 30):
        self.weights = {**PRIOR, **(weights or {})}
        self.bare, self.least = bare or {}, least

    def fit(self, chunks: list[list[str]], rounds: int = 25, rate: float = 0.5, pull: float = 0.2) -> Tagger:
        """Fit to weakly labelled chunks (lists of elements); unsuitable ones are passed over."""
        rows: list[list[list[str]]] = []
        labels: list[list[int]] = []
        fixed: list[list[bool]] = []
        for elements in chunks:
            text = "".join(elements)
            ends, at = set(), 0
            for e in elements:
                at += len(e)
                ends.add(at - (len(e) - len(e.rstrip())))
            spots = [(p, certain, d) for p, certain, d in places(text) if p < len(text.rstrip())]
            mark = [int(certain or bool({p, len(text[:p].rstrip())} & ends)) for p, certain, _ in spots]
            found = [(d, y) for (_, certain, d), y in zip(spots, mark) if not certain and d]
            scores = [sum(PRIOR.get(x, 0.0) for x in d) for d, _ in found]
            sure = [y for (d, y), v in zip(found, scores) if v >= 2.5 and "dot" not in d]
            dots = [y for (d, y), v in zip(found, scores) if v >= 2.0 and "dot" in d]  # some may be unknown abbreviations
            never = sum(y for (_, y), v in zip(found, scores) if v <= -1.0)
            strange = len(ends - {len(text.rstrip())}) - sum(y for _, y in found)
            if len(found) < 2 or never or strange > 0.1 * len(ends) or not sure + dots or sure and np.mean(sure) < 0.9 or dots and np.mean(dots) < 0.4:
                continue
            rows.append([d for _, _, d in spots])
            labels.append(mark)
            fixed.append([certain for _, certain, _ in spots])
        if sum(map(len, rows)) < 50:
            return self
        self.weights.update(fit_field(rows, labels, fixed, self.weights, rounds, rate, pull))
        return self

    def fit_bare(self, texts: list[str], most_places: int = 60_000, rounds: int = 20, rate: float = 0.5, pull: float = 0.2) -> Tagger:
        """Fit the field of unmarked stretches to text with its marks stripped, at most most_places gaps of it."""
        rows: list[list[list[str]]] = []
        labels: list[list[int]] = []
        filled = sizes = 0
        for text in texts:
            pieces = ["".join(re.findall(f"[{_UNSPACED}]", text[s:e])) for s, e in self.sentences(text)]
            pieces = [x for x in pieces if len(x) > 1]
            if len(pieces) < 2 or filled >= most_places:
                continue
            run, ends = "".join(pieces), set(np.cumsum([len(x) for x in pieces]).tolist())
            rows.append(gaps(run))
            labels.append([int(i in ends) for i in range(1, len(run))])
            filled += len(run)
            sizes += len(pieces)
        if sizes >= 20:
            self.bare = fit_field(rows, labels, [[False] * len(x) for x in labels], {"after:0": -2.0, "after:1": -4.0}, rounds, rate, pull)
            self.least = int(2 * filled / sizes)
        return self

    def _unmarked(self, text: str) -> list[int]:
        """Boundaries inside the stretches without marks."""
        out: list[int] = []
        get = self.bare.get
        for m in _STRETCH.finditer(text):
            if m.end() - m.start() >= self.least:
                known = [[get(x) for x in d] for d in gaps(m[0])]
                score = [sum(v for v in d if v is not None) if any(v is not None for v in d) else -30.0 for d in known]
                out += [m.start() + t + 1 for t in decode(score, (get("after:0", 0.0), get("after:1", 0.0)))]
        return out

    def boundaries(self, text: str) -> list[int]:
        """Ends of sentences by Viterbi over the places."""
        spots = places(text)
        get = self.weights.get
        score = [50.0 if certain else sum(get(x, 0.0) for x in d) for _, certain, d in spots]
        out = [spots[t][0] for t in decode(score, (get("after:0", 0.0), get("after:1", 0.0)))]
        return sorted({*out, *self._unmarked(text)}) if self.bare and len(text) >= self.least else out

    def sentences(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences, white space around them left out."""
        out, at = [], 0
        for end in [*self.boundaries(text), len(text)]:
            piece = text[at:end]
            s = at + len(piece) - len(piece.lstrip())
            e = at + len(piece.rstrip())
            if e > s:
                out.append((s, e))
            at = max(at, end)
        return out


def train_tagger(chunks: DataFrame, sample_chunks: int = 6000, most_chars: int = 4000, unmarked: bool = False) -> Tagger:
    """A tagger fitted to the sample_chunks chunks of at most most_chars characters with the least hash of their key.

    The bound is these parameters; the sample is all that reaches the driver. unmarked adds the field of stretches without marks.
    """
    size = F.aggregate("source_sentences", F.lit(0), lambda a, s: a + F.coalesce(F.length(s), F.lit(0)))
    rows = chunks.where(F.col("chunk_id").isNotNull() & F.col("source_sentences").isNotNull() & (F.size("source_sentences") > 1) & (size <= most_chars))
    got = rows.select("chunk_id", "source_sentences").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_chunks).collect()
    sample = [[e or "" for e in elements] for _, elements in sorted({r[0]: r[1] for r in got}.items())]
    tagger = Tagger().fit(sample)
    return tagger.fit_bare(["".join(e) for e in sample]) if unmarked else tagger


def split_sentences(chunks: DataFrame, tagger: Tagger) -> DataFrame:
    """chunk_id, sentence_no, start_char, end_char of every sentence of the joined text of each chunk; no text is shuffled."""
    sent = chunks.sparkSession.sparkContext.broadcast((tagger.weights, tagger.bare, tagger.least))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = Tagger(*sent.value)
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for key, raw in zip(b["chunk_id"].to_pylist(), b["source_sentences"].to_pylist()):
                for n, (s, e) in enumerate(tag.sentences("".join(x or "" for x in raw))):
                    for c, v in zip(cols, (key, n, s, e)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["chunk_id", "sentence_no", "start_char", "end_char"])

    return (
        chunks.select("chunk_id", "source_sentences")
        .where(F.col("source_sentences").isNotNull())
        .mapInArrow(run, "chunk_id long, sentence_no int, start_char int, end_char int")
        .distinct()
    )
