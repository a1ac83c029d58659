"""Vectorised word arithmetic over Arrow string arrays.

A word is a run of bytes other than space and \\t..\\r. Words get 64-bit polynomial hashes over their
UTF-8 bytes; windows of words combine those by doubling. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C17
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = 0xD6E8FEB86659FD93
#: Bytes of text that are worked on at once, but for longer single texts.
PIECE_BYTES = 512 << 10
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; those that slices of usual size need are kept."""
    if len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    found = []
    for factor in (_BASE, _UNBASE):
        steps = np.full(max(n, PIECE_BYTES + 1), factor, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps))
    if n <= PIECE_BYTES + 1:
        _powers["up"], _powers["down"] = found
    return found[0][:n], found[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(array: pa.Array, max_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of whole texts of about max_bytes, with the index of their first row."""
    offsets = string_buffers(array)[1]
    start = 0
    while start < len(array):
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        end = min(len(array), max(end, start + 1))
        yield start, array.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offset of each text in them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


class Words:
    """The words of a slice of texts: byte spans, 64-bit hashes and the text each belongs to."""

    def __init__(self, array: pa.Array) -> None:
        self.data, self.offsets = string_buffers(array)
        n = len(self.data)
        self.space = SPACE[self.data]
        inside = ~self.space
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= self.space[:-1]
        ends[:-1] &= self.space[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(first)
        self.first = first[:-1]
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * up[:n], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def whole(self, size: int) -> np.ndarray:
        """Indexes of the words at which a window of `size` words of one text starts."""
        last = (self.first + self.counts)[self.text]
        return np.flatnonzero(np.arange(len(self.text)) + size <= last)


def windows(hashes: np.ndarray, size: int, step: int = _STEP) -> np.ndarray:
    """Polynomial hashes of all windows of `size` consecutive hashes, by doubling."""
    step %= 2**64
    out, length = hashes, 1
    for bit in bin(size)[3:]:
        if len(out) <= length:
            return np.zeros(0, np.uint64)
        out = out[:-length] + out[length:] * np.uint64(pow(step, length, 2**64))
        length *= 2
        if bit == "1":
            if len(out) < 2:
                return np.zeros(0, np.uint64)
            out = out[:-1] + hashes[length : length + len(out) - 1] * np.uint64(pow(step, length, 2**64))
            length += 1
    return out


def lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` consecutive values."""
    return _slide(values, size, np.minimum)


def highest(values: np.ndarray, size: int) -> np.ndarray:
    """Maximum of each run of `size` consecutive values."""
    return _slide(values, size, np.maximum)


def _slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    if len(values) < size:
        return values[:0]
    out, length = values, 1
    while length * 2 <= size:
        out = pick(out[:-length], out[length:])
        length *= 2
    rest = size - length
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
