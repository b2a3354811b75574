"""Hashed character n-grams of whole texts, as NumPy arrays over a chunk of texts."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np


@functools.cache
def _letters() -> np.ndarray:
    """Is a code point of the basic plane a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)), bool, 1 << 16)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with 0 for whatever is no letter, and each text's start; texts are parted by a 0.

    The first value is a 0 too, so each text lies between zeros. Letters beyond the basic plane are looked up one by one.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in lowered], out=starts[1:])
    high = codes >= 1 << 16
    if high.any():
        own = np.unique(codes[high])
        other = np.array([c for c in own.tolist() if unicodedata.category(chr(c))[0] != "L"], np.uint32)
        codes[np.isin(codes, other)] = 0
        low = ~high
        codes[low] *= _letters()[codes[low]]
    else:
        codes *= _letters()[codes]
    return codes, starts + 1


def grams(codes: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the second symbol and hash (below 2**bits) of each n-gram; only its ends may be a non-letter.

    A gram whose inner symbols are letters can't reach over a border between texts, so the place tells its text.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    inner = codes[1 : n + 1] != 0
    for j in range(2, width - 1):
        inner &= codes[j : n + j] != 0
    at = np.flatnonzero(inner)
    h = np.full(len(at), np.uint32(width * 0x9E3779B1 & 0xFFFFFFFF))
    for j in range(width):
        h ^= codes[at + j]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return at + 1, h >> np.uint32(32 - bits)


def per_text(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first gram of each text, and their end: grams come in the order of their texts."""
    return np.searchsorted(places, starts)
