"""Words and their hashes as numpy arrays, for the operators that run in Python."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered_words_of(text: str | None) -> list[bytes]:
    """``words_of`` after lower-casing A-Z only."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 1 << 19

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of every run of ``k`` consecutive items, by prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                    steps = np.full(n, np.uint64(base), np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, items: np.ndarray) -> np.ndarray:
        n = len(items)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(items * self.up[:n], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the items from ``start`` up to ``end``, wherever they stand."""
        return mixed((prefix[end] - prefix[start]) * self.down[start])

    def runs(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return mixed((prefix[k:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
