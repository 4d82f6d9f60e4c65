"""Word positions and hashes of whole Arrow batches of texts, with numpy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are hashed in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(size, _BASE)), np.cumprod(np.full(size, inverse))


class Words:
    """Words of a few texts: ``start``, ``end`` (bytes in ``data``), ``hash``.

    Text i has the bytes ``offsets[i]:offsets[i+1]`` and the words ``first[i]:first[i+1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]  # texts follow one another without a gap
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        size = 1 << max(16, int(len(data)).bit_length())
        power, inverse = _powers(size)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64) * _BASE)


def word_groups(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """``(from, to, Words)`` for consecutive groups of texts; a null text has no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        to = min(to, len(texts))
        own = offsets[at : to + 1]
        yield at, to, Words(data[own[0] : own[-1]], own - own[0], lower)
        at = to


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive hashes, whatever text they are in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = mix(out * _BASE + hashes[i : i + n])
        return out


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``hashes[start:end]`` for each pair; equal spans have equal hashes."""
    power, inverse = _powers(1 << max(16, int(len(hashes)).bit_length()))
    total = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(hashes) * power[: len(hashes)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _BASE)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, step = np.arange(len(values)), 1
    while step < width:
        move = min(step, width - step)
        left, right = place[:-move], place[move:]
        place = np.where(values[right] < values[left], right, left)
        step += move
    return place[:n]
