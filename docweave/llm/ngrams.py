"""Vectorised hashing of word and byte n-grams into a table of 2**bits slots."""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np

_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def number_words(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's place in the list of distinct words, and that list."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    return ids, list(seen)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def fold(h: np.ndarray, family: int, bits: int) -> np.ndarray:
    """Slots of 32-bit hashes; families of n-grams spread differently over one table."""
    return ((h ^ _MIX[family]) * _MIX[0]) >> np.uint32(32 - bits)


def word_bigrams(h: np.ndarray) -> np.ndarray:
    return h[:-1] * _MIX[1] + (h[1:] ^ (h[1:] >> np.uint32(15))) * _MIX[2]


def byte_ngrams(data: bytes, n: int) -> np.ndarray:
    """32-bit hashes of all byte n-grams, n up to 4, in order."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < n:
        return np.empty(0, np.uint32)
    h = b[: len(b) - n + 1].astype(np.uint32)
    for i in range(1, n):
        h <<= np.uint32(8)
        h |= b[i : len(b) - n + 1 + i]
    return h


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
