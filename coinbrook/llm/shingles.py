"""Word shingles: the sets that near-duplicate operators compare."""

from __future__ import annotations

import re

import numpy as np

WORDS_IN_SHINGLE = 5
#: Words held by a memo before it is emptied, and the longest of them: 15 MB of a worker, 30 at most.
MEMO_WORDS, MEMO_LENGTH = 60_000, 40
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def word_hashes(tokens: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``memo`` is the caller's and is emptied when large."""
    import xxhash

    if len(memo) > MEMO_WORDS:
        memo.clear()
    out = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        h = memo.get(t)
        if h is None:
            h = xxhash.xxh3_64_intdigest(t)
            if len(t) <= MEMO_LENGTH:
                memo[t] = h
        out[i] = h
    return out


def shingle_hashes(hashes: np.ndarray, k: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """A 64-bit hash for each ``k`` words in a row; fewer words than ``k`` are one shingle, no word is none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out
