"""Words, shingles and window hashes of whole Arrow batches of texts, as numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Bytes of longer UTF-8
sequences are never in that set, so splitting bytes and splitting characters agree.
All sums are modulo 2**64, as numpy's unsigned integers wrap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32
_MASK = (1 << 64) - 1
CHUNK_BYTES = 256 << 10  # the arrays for words, windows and token ids take some 100 times as much


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Polynomial:
    """Rolling hashes sum(value[j] * base**(j - start)) of all ranges of one array."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = n + (n >> 3)
            self._up = np.ones(size, dtype=np.uint64)
            self._up[1:] = np.uint64(self.base)
            self._down = np.ones(size, dtype=np.uint64)
            self._down[1:] = np.uint64(self.inverse)
            np.multiply.accumulate(self._up, out=self._up)
            np.multiply.accumulate(self._down, out=self._down)
        return self._up[:n], self._down[:n]

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTES = _Polynomial(0x5851F42D4C957F2D)
_WINDOWS = (_Polynomial(0xD1342543DE82EF95), _Polynomial(0xAF251AF3B0F025B5))
_EXACT, _LOWER = _table(1), _table(1)[_FOLDED]


@dataclass
class Words:
    """The words of consecutive texts: ``hashes`` of all, ``bounds`` of each text among them."""

    hashes: np.ndarray
    bounds: np.ndarray  # of words: text i has words bounds[i] to bounds[i + 1]
    starts: np.ndarray  # of bytes, in ``data``
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every window of ``width`` words inside one text, and its first word."""
        n = np.maximum(self.counts - width + 1, 0)
        first = expand(self.bounds[:-1], n)
        return _WINDOWS[which].ranges(self.hashes, first, first + width), first


def sequence(found: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of runs of words, each from its start to before its end."""
    return _WINDOWS[0].ranges(found.hashes, starts, ends)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (counts[i] of them), for all i in a row."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the bounds of each; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the bytes from each start to before its end."""
    values = _EXACT[data]
    return _BYTES.ranges(values, starts, ends), _WINDOWS[1].ranges(values, starts, ends)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of an Arrow string array; null counts as empty. ``lower`` folds A-Z."""
    data, offsets = text_bytes(texts)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    left, right = ~gap[1:-1] & gap[:-2], ~gap[1:-1] & gap[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end ends its last word
    left[inner] = ~gap[1:-1][inner]
    right[inner - 1] = ~gap[1:-1][inner - 1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    hashes = _BYTES.ranges((_LOWER if lower else _EXACT)[data], starts, ends)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """Consecutive slices of about ``most`` bytes (a text is never cut), as (first row, slice)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield first, texts.slice(first, i - first)
            first, held = i, 0
        held += int(size)
    if len(texts) > first:
        yield first, texts.slice(first)
