"""Vectorised words, word windows and their hashes over the Arrow batches of a task.

A word is a maximal run of bytes outside space and \\x09-\\x0D. Every word has two independent 64-bit hashes (lanes): of its own
sixteen bytes and length where it isn't longer, else the halves of its XXH3-128. Windows are hashed by doubling: a window of 2^k words by a
scrambling of its halves, any other length by its binary parts, so that no algebraic structure of the words carries over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at once; a longer document is hashed alone.
SLICE = 4 << 20

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Low bytes of a long that belong to a word of so many bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C17), _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ _U(seed * 0xA24BAED4963EE407 & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows (null: none) and where each row begins, with the end last."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words of some documents: starts and ends in data, and the first word of each document (with the end last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        blank = np.ones(n + 2, bool)
        blank[1:-1] = _BLANK[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        inside = ~blank[1:-1]
        self.starts = np.flatnonzero(inside & (blank[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inside & (blank[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._levels: dict[int, list[np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """Each word's hash in a lane (0 or 1)."""
        if lane not in self._levels:
            held = np.concatenate([self.data, np.zeros(16, np.uint8)])
            eight = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))  # eight bytes from each place on
            size = self.ends - self.starts
            low, high = eight[self.starts] & _MASK[np.minimum(size, 8)], eight[self.starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
            out = mix(mix(low, 31 + lane) * _LEFT + high, 33 + lane) * _RIGHT + size.astype(_U)
            out = mix(out, 35 + lane)
            long = np.flatnonzero(size > 16)
            text = self.data.tobytes() if len(long) else b""
            for k, a, b in zip(long.tolist(), self.starts[long].tolist(), self.ends[long].tolist(), strict=True):
                out[k] = (xxhash.xxh3_128_intdigest(text[a:b]) >> 64 * lane) & (2**64 - 1)
            self._levels[lane] = [out]
        return self._levels[lane][0]

    def _doubled(self, level: int, lane: int) -> np.ndarray:
        """Hashes of the 2^level words from each word on (past the end: of no use)."""
        self.hashes(lane)
        levels = self._levels[lane]
        while len(levels) <= level:
            step, after = 1 << (len(levels) - 1), np.zeros(len(self), _U)
            after[: max(len(self) - step, 0)] = levels[-1][step:]
            levels.append(mix(levels[-1] * _LEFT + after, len(levels)))
        return levels[level]

    def windows(self, at: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
        """Hashes of the windows of so many words that begin at these words."""
        bits = [k for k in range(length.bit_length()) if length >> k & 1][::-1]
        out, place = self._doubled(bits[0], lane)[at], at + (1 << bits[0])
        for k in bits[1:]:
            out = mix(out * _RIGHT + self._doubled(k, lane)[place], 64 + k)
            place = place + (1 << k)
        return mix(out + _U(length), 63)

    def sequences(self, docs: np.ndarray, lane: int = 0) -> np.ndarray:
        """Hashes of the whole word sequences of these documents, each of one word at least: sums of each word scrambled with its place."""
        sums = np.zeros(len(self) + 1, _U)
        place = np.arange(len(self)) - np.repeat(self.first[:-1], np.diff(self.first))
        np.cumsum(mix(self.hashes(lane) ^ mix(place.astype(_U), 41 + lane), 43), out=sums[1:])
        first, last = self.first[docs], self.first[docs + 1]
        return mix(sums[last] - sums[first] + (last - first).astype(_U), 45)


def sliced_words(column: pa.Array, lower: bool = False, most: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """First and last row and the words of each slice of a batch."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, most):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
