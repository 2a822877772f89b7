"""One form for texts that look the same (problem 4).

A batch of Arrow text becomes one array of code points. Lookup tables give each code point its expansion: the wide and narrow
forms' plain ones, canonical decompositions, one space for all sorts of space, one hyphen, letters and ideographs of the same
shape, and nothing for invisible characters. Expansions are gathered by offsets, marks are put in canonical order by one
stable sort, and composed mark by mark over all characters at once. No text is touched by itself.

What differs visibly stays apart: case, digits, ligatures, punctuation of another kind, runs of spaces, line breaks.

Defined cases: null stays null, an empty text empty; a text of invisible characters only becomes empty; lone marks stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.llm.arrow_text import code_points
from sagaloom.llm.bpe import IntMap
from sagaloom.session import cut

_LIMIT = 0x110000
#: Hyphens that look like the plain one.
HYPHENS = "‐‑‒⁃﹣－−"
#: Invisible characters outside the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ⠀"
#: Letters of the same shape, used where the JVM has no Unicode confusables at hand.
FEW_LETTERS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
}
_SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC")
_SHAPES = ("CJK", "KANGXI", "KATAKANA")


def same_shapes(spark: SparkSession) -> dict[str, str]:
    """Letters and ideographs by the plain one of the same shape, from the Unicode confusables in Spark's ICU, without which this fails.

    Letters of other alphabets go to the ASCII letter of their case with the same skeleton; radicals and the few Katakana that
    equal an ideograph go to it. Latin letters and digits are never folded, as their differences are visible spelling.
    """
    out = dict(FEW_LETTERS)
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    plain = {checker.getSkeleton(c): c for c in "ABCDEFGHJKLMNOPQRSTUVWXYZabcdefghijklnopqrstuvwxyz"}
    letters = [chr(c) for c in [*range(0x370, 0x590), *range(0x13A0, 0x1400), *range(0x2C80, 0x2D00), *range(0x2E80, 0x3200), *range(0xA4D0, 0xA500), *range(0xAB70, 0xABC0)]]
    letters = [c for c in letters if unicodedata.category(c)[0] == "L" or unicodedata.name(c, "").split(" ")[0] in ("CJK", "KANGXI")]
    shapes = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(shapes) != len(letters):
        raise RuntimeError("the confusables of this ICU change the number of lines")
    for c, shape in zip(letters, shapes):
        script, upper = unicodedata.name(c, "").split(" ")[0], c != c.lower()
        if script in _SCRIPTS:
            to = "I" if upper and shape == "l" else plain.get(shape, "")
            if to and (to.isupper() == upper or script in ("CHEROKEE", "LISU")):
                out[c] = to
        elif script in _SHAPES and len(shape) == 1 and "CJK UNIFIED" in unicodedata.name(shape, ""):
            out[c] = shape
    out["ー"] = "一"  # the long mark and the ideograph one share a skeleton
    return out


@lru_cache(2)
def _tables(shapes: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, IntMap]:
    """start and size of each code point's expansion, the expansions in a row, combining classes, and composed pairs."""
    fold = dict(shapes)
    special: dict[int, str] = {}
    pairs: dict[int, int] = {}
    classes = np.zeros(_LIMIT, np.uint8)
    for c in range(0x80, _LIMIT):
        if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0x4DB6 or 0x4E00 <= c < 0x9FA6 or 0xE000 <= c < 0xF900 or 0x20000 <= c < 0x2F800 or 0x30000 <= c < 0xE0000:
            continue
        x = chr(c)
        cat, way = unicodedata.category(x), unicodedata.decomposition(x)
        classes[c] = unicodedata.combining(x)
        if cat == "Cn":
            continue
        if cat == "Cf" or x in INVISIBLE or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            special[c] = ""
            continue
        if cat == "Zs":
            special[c] = " "
            continue
        y = "-" if x in HYPHENS else x
        if way.startswith(("<wide>", "<narrow>")) or (way.startswith("<compat>") and 0x2E80 <= c < 0x2FE0):
            y = "".join(chr(int(p, 16)) for p in way.split(" ")[1:])
            y = "-" if y in HYPHENS else y
        y = unicodedata.normalize("NFD", y)
        y = "".join(fold.get(z, z) for z in y)
        if y != x:
            special[c] = y
        if way and way[0] != "<" and " " in way and unicodedata.normalize("NFC", x) == x:
            a, b = (int(p, 16) for p in way.split(" "))
            pairs[a << 21 | b] = c
    # letters folded to another shape compose by that shape's pairs
    special[9] = " "
    size, start = np.ones(_LIMIT, np.int8), np.zeros(_LIMIT, np.int32)
    flat: list[int] = []
    for c, y in special.items():
        start[c], size[c] = len(flat), len(y)
        flat.extend(map(ord, y))
    folded = np.zeros(_LIMIT, bool)
    folded[list(special)] = True
    start[~folded] = -1
    keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
    return start, size, np.array(flat or [0], np.uint32), classes, IntMap(keys, np.fromiter(pairs.values(), np.int64, len(pairs)))


def _compose(codes: np.ndarray, text: np.ndarray, ccc: np.ndarray, pairs: IntMap) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, then composed with their base, mark by mark over all characters at once."""
    n = len(codes)
    base = ccc == 0
    base[0] = True
    base[1:] |= text[1:] != text[:-1]
    group = np.cumsum(base) - 1
    order = np.lexsort((np.arange(n), ccc, group))
    codes, ccc, text = codes[order], ccc[order], text[order]
    first = np.flatnonzero(base)
    count = np.diff(np.append(first, n))
    gone = np.zeros(n, bool)
    last = np.zeros(len(first), np.int16)
    for k in range(1, int(count.max())):
        g = np.flatnonzero(count > k)
        b, m = first[g], first[g] + k
        made = pairs.get(codes[b].astype(np.int64) << 21 | codes[m])
        hit = (made >= 0) & ((last[g] == 0) | (last[g] < ccc[m])) & (ccc[b] == 0)
        codes[b[hit]] = made[hit]
        gone[m[hit]] = True
        last[g[~hit]] = ccc[m[~hit]]
    codes, text = codes[~gone], text[~gone]
    # Hangul: leading consonant and vowel, then the final consonant
    if len(codes) and ((codes >= 0x1100) & (codes < 0x1200)).any():
        for of in ("vowel", "final"):
            a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
            if of == "vowel":
                ok = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
                to = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
            else:
                ok = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
                to = a + b - 0x11A7
            ok &= text[:-1] == text[1:]
            at = np.flatnonzero(ok)
            codes = codes.copy()
            codes[at] = to[at]
            keep = np.ones(len(codes), bool)
            keep[at + 1] = False
            codes, text = codes[keep], text[keep]
    return codes, text


def one_form(texts: pa.Array, shapes: tuple[tuple[str, str], ...]) -> pa.Array:
    """The texts of an Arrow string array in their one form."""
    start, size, flat, classes, pairs = _tables(shapes)
    codes, lengths = code_points(texts)
    text = np.repeat(np.arange(len(texts)), lengths)
    n = size[codes].astype(np.int64)
    s = start[codes]
    out = np.repeat(codes, n)
    special = np.repeat(s >= 0, n)
    at = np.repeat(s, n) + np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
    out[special] = flat[at[special]]
    text = np.repeat(text, n)
    if len(out):
        ccc = classes[out]
        if ccc.any() or ((out >= 0x1100) & (out < 0x1200)).any():
            out, text = _compose(out, text, ccc, pairs)
    width = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, width, len(texts)).astype(np.int64))])
    data = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())
    return pc.if_else(texts.is_valid(), made, pa.scalar(None, pa.string())) if texts.null_count else made


@lru_cache(1)
def _unstable(shapes: tuple[tuple[str, str], ...]) -> np.ndarray:
    """All code points that may change: a text without any of them is in its one form already."""
    start, _, _, classes, _ = _tables(shapes)
    may = (start >= 0) | (classes > 0)
    may[0x1100:0x1200] = True
    return may


#: The characters with the White_Space property.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(c: Column) -> Column:
    """Surrounding white space of any sort removed."""
    return F.btrim(c, F.lit(WHITE))


def same_look_pairs(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text_a, text_b: pairs of different texts with equal keys and one form, the smaller by code point first.

    In one pass each text is reduced to 128 bits of hash of its keys and form, and 64 of itself. Only these are exchanged, to
    find the forms of more than one text; the few texts of those forms are then looked up, by broadcast or behind a Bloom filter
    as the planner sees fit, and compared by their forms. A text that equals its form is not kept: among the members of a form
    it is the form itself.
    """
    spark = texts.sparkSession
    shapes = tuple(sorted(same_shapes(spark).items()))
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = _unstable(shapes)
        for b in batches:
            codes, lengths = code_points(b["text"])
            rows = np.unique(np.searchsorted(np.cumsum(lengths), np.flatnonzero(may[codes]), "right"))
            few = b["text"].take(pa.array(rows, pa.int64()))
            form = one_form(few, shapes)
            changed = np.asarray(pc.not_equal(form, few).fill_null(False), bool)
            where = np.full(b.num_rows, -1, np.int64)
            where[rows[changed]] = np.flatnonzero(changed)
            at = pa.array(where, mask=where < 0)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in (*keys, "h1", "h2", "t")), few.take(at), form.take(at)], names=[*keys, "h1", "h2", "t", "text", "form"])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, one_form(b["text"], shapes)], names=[*b.schema.names, "form"])

    one, two, own = (lambda c: F.xxhash64(*keys, c)), (lambda c: F.xxhash64(F.lit("second"), *keys, c)), (lambda c: F.xxhash64(c))
    rows = texts.select(*keys, F.col(text).alias("text")).where("text is not null").select(*keys, one("text").alias("h1"), two("text").alias("h2"), own("text").alias("t"), "text")
    judged = rows.mapInArrow(run, f"{kinds}, h1 long, h2 long, t long, text string, form string")
    new = F.col("form").isNotNull()
    seen = cut(judged.select(*keys, F.when(new, one("form")).otherwise(F.col("h1")).alias("h1"), F.when(new, two("form")).otherwise(F.col("h2")).alias("h2"), "t", "text"))
    met = seen.groupBy("h1", "h2").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a <> z").select("h1", "h2")
    members = cut(seen.join(met, ["h1", "h2"], "left_semi").select(*keys, "h1", "h2", "text").distinct())
    changed = members.where("text is not null").mapInArrow(forms, f"{kinds}, h1 long, h2 long, text string, form string")
    plain = members.where("text is null").select("h1", "h2")
    still = changed.select(*keys, "h1", "h2", "form").distinct().join(plain, ["h1", "h2"], "left_semi").select(*keys, "h1", "h2", F.col("form").alias("text"), "form")
    every = changed.unionByName(still)
    a, b = (every.select(*keys, "h1", "h2", "form", F.col("text").alias(n)) for n in ("text_a", "text_b"))
    return a.join(b, [*keys, "h1", "h2", "form"]).where("text_a < text_b").select(*keys, "text_a", "text_b")
