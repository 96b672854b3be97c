"""Counts over whole texts that several operators need; plain numpy inside Arrow tasks."""

from __future__ import annotations

import numpy as np

SPACE_BYTES = b" \t\n\x0b\x0c\r"
SYMBOL_BYTES = b"#*$%&|<>"


class WordHashes(dict):
    """64-bit hashes of words, each computed once; emptied when full, so memory is bounded."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word windows; with fewer words, of the whole sequence as one; without words, none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - width + 1 + i]
    return mixed(out)


def repeated_words(hashes: np.ndarray, k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more."""
    if len(hashes) < k + 1:
        return 0
    windows = shingles(hashes, k)
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.isin(windows, again)
    step = np.zeros(len(hashes) + 1, np.int64)
    step[: len(windows)] += starts
    step[k : len(windows) + k] -= starts
    return int((np.cumsum(step[:-1]) > 0).sum())


def counted(data: bytes, kinds: bytes) -> int:
    return len(data) - len(data.translate(None, kinds))
