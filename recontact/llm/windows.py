"""Hashes of word windows in numpy, for operators that compare runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two polynomial hashes (any odd numbers that are 3 modulo 8 serve), and of the final mixing.
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
#: Distinct words whose digests a task remembers.
REMEMBERED = 300_000


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Digests(dict):
    """Digests of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = digest = xxhash.xxh3_128_digest(word)
        return digest


class WordHasher:
    """Two independent 64-bit hashes of every run of ``length`` words."""

    def __init__(self, length: int):
        self.length = length
        self.known = _Digests()
        self.powers = [np.ones(1, np.uint64) for _ in BASES]
        self.inverses = [np.ones(1, np.uint64) for _ in BASES]

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) < n:
            size = max(n, 4096, 2 * len(self.powers[0]))
            for k, base in enumerate(BASES):
                inverse = pow(base, -1, 1 << 64)
                for table, factor in ((self.powers, base), (self.inverses, inverse)):
                    steps = np.full(size, factor, np.uint64)
                    steps[0] = 1
                    table[k] = np.multiply.accumulate(steps)

    def words(self, text: str | None) -> list[bytes]:
        """Runs of non-blank characters (bytes.split cuts at exactly space, \\t, \\n, \\v, \\f and \\r)."""
        return (text or "").encode("utf-8", "surrogatepass").split()

    def hashes(self, words: list[bytes], both: bool = True, length: int | None = None) -> tuple[np.ndarray, ...]:
        """Hashes of the runs that start at word 0, 1, ...; empty arrays if there are fewer words than the length."""
        length = length or self.length
        n = len(words)
        if n < length:
            return tuple(np.zeros(0, np.uint64) for _ in range(2 if both else 1))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        digests = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64).reshape(n, 2)
        self._grow(n + 1)
        out = []
        for k in range(2 if both else 1):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(digests[:, k] * self.powers[k][:n], out=sums[1:])
            out.append(mixed((sums[length:] - sums[:-length]) * self.inverses[k][:n - length + 1]))
        return tuple(out)
