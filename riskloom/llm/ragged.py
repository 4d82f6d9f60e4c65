"""Lists of uneven length as flat numpy arrays with offsets, and as Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive lists: one more than there are lists."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flat places ``starts[i] .. starts[i] + lengths[i] - 1`` of all lists in a row, and the offsets of the result."""
    out = starts_of(lengths)
    return np.repeat(starts - out[:-1], lengths) + np.arange(out[-1]), out


def chosen(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``codes`` one after another, flat, and their offsets."""
    at, out = places(offsets[:-1][codes], np.diff(offsets)[codes])
    return values[at], out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each list; zero for an empty one."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def as_lists(values: pa.Array | np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def joined(strings: pa.Array, codes: np.ndarray, offsets: np.ndarray, separator: str) -> pa.Array:
    """For each list of codes the strings of that number, joined."""
    return pc.binary_join(as_lists(strings.take(pa.array(codes)), offsets), separator)


def text_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of ``texts`` of about ``size`` bytes, each with its first place; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, texts.slice(at, to - at)
        at, before = to, int(ends[to - 1])
