"""64-bit hashes of words and runs of words, as numpy arrays."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from types import ModuleType

import numpy as np

MASK = (1 << 64) - 1
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit moves every output bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_lower(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Digests(dict):
    """Words to hashes; an absent word is hashed when it is asked for."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.digest(word)
        return value


class WordHasher:
    """xxh64 of words, with a cache of bounded size (checked between calls)."""

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.cache = limit, _Digests()

    @classmethod
    def of_worker(cls, limit: int = 1 << 18) -> WordHasher:
        """This process's hasher: a worker that runs further tasks keeps its cache."""
        kept = sys.modules.setdefault("_massloom_worker", ModuleType("_massloom_worker")).__dict__
        if "hasher" not in kept:
            kept["hasher"] = cls(limit)
        kept["hasher"].limit = limit
        return kept["hasher"]

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self.cache) > self.limit:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of all words if there are fewer; none if none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, width)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out ^ hashes[j : n - width + 1 + j])
    return out


def shingles(text: str | None, hasher: WordHasher, width: int) -> np.ndarray:
    """The sorted set of a text's shingles."""
    return np.unique(runs(hasher(words_lower(text)), width))
