"""Folding of code points for comparisons that ignore case, width, accents, look-alike letters, spacing and punctuation."""

from __future__ import annotations

import unicodedata

import numpy as np

from sagaloom.llm.lookalikes import FEW_LETTERS


def letter_table(signs: dict[str, str] | None = None, keep: str = "L", latin: bool = False) -> np.ndarray:
    """The folded letter of each code point; 0 for all whose category is not in keep. signs overrides single characters.

    With latin, capitals of other alphabets are read as the Latin capitals of their shape (for names in Latin letters); without
    it, a capital folds like its small letter, so words of those alphabets stay whole.
    """
    out = np.zeros(0x110000, np.uint32)
    for a, z in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2A6E0), (0x2A700, 0x2F800)):
        out[a:z] = np.arange(a, z)
    for c in [*range(0x20, 0x3400), *range(0xA000, 0xABC0), *range(0xF900, 0xFB00), *range(0xFF00, 0xFFF0)]:
        x = FEW_LETTERS.get(chr(c), chr(c)) if latin else chr(c)
        x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", x).lower())[:1]
        x = FEW_LETTERS.get(x, x)
        out[c] = ord(x) if x and unicodedata.category(x)[0] in keep else 0
    for a, b in (signs or {}).items():
        out[ord(a)] = ord(b) if b else 0
    return out
