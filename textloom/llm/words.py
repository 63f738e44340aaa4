"""Word hashes for the operators that work on shingles and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words kept by a worker, about 60 MB; beyond it the table starts anew.
KEPT = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """63-bit hashes of words, as unsigned 64-bit numbers."""
    if len(_hashes) > KEPT:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    """Gives back what this worker keeps of words and of batches; for tasks that keep much else."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))
