"""Word shingles as 64-bit hashes, and their universal hash minima.

A text's words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing
A-Z. A shingle's hash is a polynomial over its bytes (words joined by one space)
taken from prefix sums, so a whole text is hashed by a few array operations.
"""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240229


class Shingler:
    """Turns texts into sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self._byte_value = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._powers, self._inverses

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of all shingles in order, repeated ones too."""
        joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
        if not joined:
            return np.empty(0, np.uint64)
        raw = np.frombuffer(joined, np.uint8)
        powers, inverses = self._tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self._byte_value[raw] * powers[: len(raw)], out=sums[1:])
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(raw)]))
        if len(starts) > self.words:
            starts, ends = starts[: len(starts) - self.words + 1], ends[self.words - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        h = (sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def distinct(self, text: str) -> np.ndarray:
        return np.unique(self.shingles(text))


class Minima:
    """``n`` multiply-add-shift minima of a set of 64-bit hashes."""

    CHUNK = 4096

    def __init__(self, n: int):
        rng = np.random.default_rng(_SEED + 1)
        self._a = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
        self._b = rng.integers(0, 2**64, n, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        best = np.full(len(self._a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(hashes), self.CHUNK):
            part = hashes[at : at + self.CHUNK, None] * self._a
            part += self._b
            part >>= np.uint64(32)
            np.minimum(best, part.min(0).astype(np.uint32), out=best)
        return best
