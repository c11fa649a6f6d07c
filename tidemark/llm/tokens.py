"""Words of a text as 64-bit hashes, shared by the operators on word windows."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MEMO = 300_000
TEXT_AT_ONCE = 2_000_000
"""Bytes of text that become Python's at once, as a worker keeps the memory that its largest part took."""


class WordHashes(dict):
    """word -> hash, filled as words come; emptied when it has ``MEMO`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, in lower case and without what stands between them; empty for null."""
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def window_hashes(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``offsets`` of every window, which is as wide as the last offset says."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[o : o + n]
    return mixed(out)
