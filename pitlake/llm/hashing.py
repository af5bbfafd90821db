"""64-bit hashes of words and their combinations, whole arrays at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker keeps with their hashes before it starts anew.
CACHE = 60_000
C1, C2, C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S = np.uint64(31)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S)) * C2
    return x ^ (x >> S)


def nth(n: int) -> np.uint64:
    """The n-th multiple of a large odd constant, modulo 2**64."""
    return np.uint64(n * int(C3) & (1 << 64) - 1)
