"""Words and runs of words as 64-bit hashes, for a batch of texts at once.

Words are the lower-cased text split at everything that is neither letter nor digit (Unicode)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Distinct words that a worker keeps the hash of.
KEPT = 1_000_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class WordHashes(dict):
    """Hash of a word, kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(texts: Iterable[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order; number of words of each text."""
    found: list[int] = []
    counts = []
    for text in texts:
        words = WORD.findall(text.lower()) if text else []
        counts.append(len(words))
        found.extend(map(hashes.__getitem__, words))
    return np.array(found, dtype=np.uint64), np.array(counts, dtype=np.int64)


def runs(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within a text, in order; index of its text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(words) - n + 1
    h = words[:last].copy()
    for i in range(1, n):
        h = h * ODD[i % 3] + words[i : last + i]
    within = doc[:last] == doc[n - 1 :]
    return mix(h[within]), doc[:last][within]


def distinct_runs(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As runs, each once a text, sorted by text and hash."""
    h, doc = runs(words, counts, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]
