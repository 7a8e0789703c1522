"""Words of many texts at once, as ranges of their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words: digits, letters and all that isn't ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def word_ranges(part: np.ndarray, at: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (n + 1 of them)."""
    word = in_word[part]
    cut = np.zeros(len(part) + 1, dtype=bool)
    cut[at] = True
    before = np.append(False, word[:-1]) & ~cut[:-1]
    after = np.append(word[1:], False) & ~cut[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, at)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between the ``bounds``."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.float64))[bounds])
