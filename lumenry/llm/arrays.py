"""Texts of an Arrow batch as one array of code points, for work on all of them at once."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Character classes of `CLASS`.
OTHER, WORD, UNIT, MARK = 0, 1, 2, 3
_PLANES = 0x20000


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts (one more entry: the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def is_unspaced(cp: int) -> bool:
    """Scripts written without spaces between words, whose single signs serve as words."""
    return 0x0E00 <= cp <= 0x0EFF or 0x1000 <= cp <= 0x109F or 0x1780 <= cp <= 0x17FF or 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0x20000 <= cp


def _class(cp: int) -> int:
    kind = unicodedata.category(chr(cp))
    if kind[0] == "M":
        return MARK
    if kind[0] in "LN":
        return UNIT if is_unspaced(cp) else WORD
    return OTHER


_TABLE: np.ndarray | None = None


def classes(cps: np.ndarray) -> np.ndarray:
    """The character class of each code point."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter(map(_class, range(_PLANES)), np.uint8, _PLANES)
    found = _TABLE[np.minimum(cps, _PLANES - 1)]
    found[cps >= _PLANES] = UNIT
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the text of each. A sign of an unspaced script, with its marks, is a word."""
    cps, starts = codepoints(texts)
    kind = classes(cps)
    before = np.concatenate([[OTHER], kind[:-1]]) if len(kind) else kind
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    fresh = np.zeros(len(cps), bool)
    fresh[starts[:-1][np.diff(starts) > 0]] = True
    # A mark stays with the sign before it; a word runs until another class begins.
    inside = (kind == MARK) & (before != OTHER) & ~fresh
    effective = kind.copy()
    effective[inside] = WORD
    after_unit = _after_unit(kind, fresh)
    begins = ((kind == UNIT) | ((kind == WORD) & (fresh | (before == OTHER) | after_unit)) | ((kind == MARK) & ~inside))
    kept = np.flatnonzero(kind != OTHER)
    if not len(kept):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word_no = np.cumsum(begins)[kept] - 1
    first = np.flatnonzero(begins)
    with np.errstate(over="ignore"):
        place = (kept - first[word_no]).astype(np.uint64)
        parts = mix(cps[kept].astype(np.uint64) + (place << np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15))
        hashes = np.add.reduceat(parts, np.flatnonzero(np.concatenate([[True], word_no[1:] != word_no[:-1]])))
    return hashes, text_of[first]


def _after_unit(kind: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where the last sign that isn't a mark was one of an unspaced script."""
    solid = np.where(kind == MARK, 0, np.arange(1, len(kind) + 1))
    last = np.maximum.accumulate(solid) - 1
    previous = np.concatenate([[-1], last[:-1]]) if len(last) else last
    return (previous >= 0) & (kind[np.maximum(previous, 0)] == UNIT) & ~fresh
