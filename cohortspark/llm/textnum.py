"""Words, hashes and windows of whole texts as numpy arrays, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: odd multipliers of the polynomial hashes (64 bits)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    steps = np.full(max(n, 1), _BASE, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


@dataclass
class Texts:
    """The bytes of some texts, A-Z in lower case; ``off`` has where each begins and where the last ends."""

    raw: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(raw[off[0] : off[-1]], off - off[0])

    def __len__(self) -> int:
        return len(self.off) - 1

    @cached_property
    def low(self) -> np.ndarray:
        return _LOWER[self.raw]

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.raw]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.space
        first = self.off[:-1][self.off[:-1] < len(inside)]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[first] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[first[first > 0] - 1] = False
        return starts, np.flatnonzero(inside & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def lengths(self) -> np.ndarray:
        """Bytes of each word."""
        return self._edges[1] - self._edges[0]

    @cached_property
    def first_word(self) -> np.ndarray:
        """Per text, and once more at the end: the number of words before it."""
        return np.searchsorted(self.starts, self.off)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    @cached_property
    def words(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        lengths = self.lengths
        if not len(lengths):
            return np.zeros(0, dtype=np.uint64)
        begin = np.cumsum(lengths) - lengths
        data = self.low[~self.space].astype(np.uint64) + np.uint64(1)
        data *= _powers(int(lengths.max()))[np.arange(len(data)) - np.repeat(begin, lengths)]
        return mix(np.add.reduceat(data, begin))

    def prefixes(self, n: int) -> np.ndarray:
        """A hash of the first ``n`` bytes of each word; 0 for shorter words."""
        out, starts = np.zeros(len(self.starts), dtype=np.uint64), self.starts
        long = self.lengths >= n
        for k, power in enumerate(_powers(n)):
            out[long] += (self.low[starts[long] + k].astype(np.uint64) + np.uint64(1)) * power
        out[long] = mix(out[long] + np.uint64(n))
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the n-byte grams without inner space; a space at an end marks a word's edge."""
        size = len(self.raw) - n + 1
        if size <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        data = np.where(self.space, np.uint8(32), self.low)
        odd = np.concatenate([[0], np.cumsum(self.space)])
        ok = odd[n - 1 : n - 1 + size] == odd[1 : 1 + size]
        text = np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.off))
        ok &= text[:size] == text[n - 1 : n - 1 + size]
        places = np.flatnonzero(ok)
        out = np.full(len(places), n, dtype=np.uint64)
        for k, power in enumerate(_powers(n)):
            out += (data[places + k].astype(np.uint64) + np.uint64(1)) * power
        return places, mix(out)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every n-word window inside a text."""
        words = self.words
        size = len(words) - n + 1
        if size <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        out = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE | 1) + words[k : k + size]
        text = self.text_of_word
        inside = text[:size] == text[n - 1 :]
        return text[:size][inside], mix(out[inside])

    def sums(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of ``values`` between neighbouring positions of ``first``."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[first[1:]] - total[first[:-1]]


def pieces(column: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or a single row."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, min(end, len(column))
        at = min(end, len(column))
